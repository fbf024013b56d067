r"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Generators propose spans of five kinds. Strict ones are the base patterns with their
checks (octets, Luhn, digit counts); loose ones find spelled-out addresses, phones
without ``+``, IPv6, shorter cards and secrets (values after a secret's name, runs of
mixed letters and digits), and may overlap the others. Every proposal gets features of
its format and of the text before and after it, and boosted trees score it.

What the trees learn from, all of it read off the texts themselves: strict proposals by
their checks; loose forms of verified spans, made by altering texts (an address spelled
out, a phone without its ``+``); loose proposals inside a verified span of another kind,
which are none of their own; a secret's value by its format where its name tells what it
is, and by its name where its format does. Proposals are first counted by feature vector,
so what reaches the driver is bounded by the number of vectors, not by the data.

A threshold by loose generator is calibrated on the proposals of held-out texts (half
of them, by hash); a generator that cannot reach the wanted precision adds nothing.
Base spans always stay. Loose proposals above their threshold that overlap no base span
compete: they are added from the one furthest above its threshold down, each unless it
overlaps one that was.

A null text is empty and has no spans. Texts of any length are read whole: positions
come from the pieces between matches (``split`` and ``regexp_extract_all`` see the same
matches), patterns have possessive loops and left boundaries, and running maxima and
cuts go by blocks, so time is near linear in the text and its spans. Rows with equal
doc_ids stay rows of their own, other columns stay as they are. Nothing is exchanged
but the counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import tasks_for

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_LUHN = f"""transform(array(reverse({_DIGITS})), d -> aggregate(sequence(1, length(d)), 0, (s, i) -> s +
  CASE WHEN i % 2 = 1 THEN CAST(substr(d, i, 1) AS INT) WHEN CAST(substr(d, i, 1) AS INT) > 4 THEN CAST(substr(d, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(d, i, 1) AS INT) * 2 END) % 10 = 0)[0]"""
_RUN = "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9])"
_NAMED = """(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)["']? {0,2}[=:] {0,2}["']?"""
_BEFORE, _AFTER = 32, 16  # characters of context that features see
# name: (kind, quick test that any match implies, pattern, SQL of what is known of a match v with b before it, base pattern?)
GENERATORS = {
    "email": (0, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "true", True),
    "ip": (1, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", f"v rlike '^{_OCTET}([.]{_OCTET}){{3}}$'", True),
    "card": (2, "[0-9][0-9 -]{14}", _RUN + "{15,18}+(?![ -]?[0-9])", _LUHN, True),
    "phone": (3, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15", True),
    "bare_email": (0, "@", rf"(?<!{_LOCAL}){_LOCAL}++@{_HOST}++(?![.]{_HOST})", "false", False),
    "spelled_email": (0, r"[(\[] ?(?:at|AT) ?[)\]]", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?[(\[] ?(?:at|AT) ?[)\]] ?{_HOST}{{1,63}}(?: ?[(\[] ?(?:dot|DOT) ?[)\]] ?{_HOST}{{1,63}}|\.{_HOST}{{1,63}})+", "null", False),
    "ipv6": (1, "[0-9A-Fa-f]:[0-9A-Fa-f]", "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "true", False),
    "short_card": (2, "[0-9][0-9 -]{11}", _RUN + "{12,14}+(?![ -]?[0-9])", f"CASE WHEN NOT {_LUHN} THEN false END", False),
    "bare_phone": (3, "[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+(.-])(?<![0-9][ ])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", "null", False),
    "named_secret": (4, _NAMED, rf"""(?<={_NAMED})[^\s"'<>,;]{{6,}}+""", "CASE WHEN v rlike '[0-9]' AND v rlike '[A-Za-z]' AND length(v) >= 12 THEN true WHEN v rlike '^[A-Za-z]+$' OR length(v) < 8 THEN false END", False),
    "mixed_run": (4, "[0-9][A-Za-z]", "(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?(?:[A-Za-z][0-9]|[0-9][A-Za-z]))[A-Za-z0-9_-]{16,}+", "CASE WHEN b rlike NAMED THEN true WHEN b rlike '[A-Za-z0-9.,] $' THEN false END", False),
}
LOOSE = [g for g, x in GENERATORS.items() if not x[4]]
# how verified spans are altered for training: (pattern, replacement)
ALTERED = (
    (r"\+[0-9]{1,3}[ .-]?(\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4})(?![0-9])", "$1"),
    (rf"(?<!{_LOCAL})({_LOCAL}++)@({_HOST}++)\.({_HOST}++)", "$1 (at) $2 (dot) $3"),
)
_CUES = "mail|phone|tel[.:]|call|fax|card|visa|server|host|address|contact|kontakt|correo"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL with ``value`` computed once and known as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sum(array: str) -> str:
    return f"aggregate({array}, 0L, (su, el) -> su + el)"


def _most(array: str) -> str:
    return f"coalesce(array_max({array}), 0L)"


def _running(array: str, of=_sum, inclusive: bool = True) -> str:
    """Running sums (or maxima of numbers not below 0) of an array, in blocks so that many matches cost little more than few."""
    blocks = "transform(sequence(0, greatest(0, (size(dd) - 1) div 64)), bb -> slice(dd, bb * 64 + 1, 64))"
    both = (lambda x, y: f"{x} + {y}") if of is _sum else (lambda x, y: f"greatest({x}, {y})")
    inner = f"flatten(transform(bl, (b1, i1) -> transform(b1, (v1, j1) -> {both('bo[i1]', of(f'slice(b1, 1, j1 + {int(inclusive)})'))})))"
    return _let(array, "dd", _let(blocks, "bl", _let(f"transform(bl, b2 -> {of('b2')})", "bs", _let(f"transform(bs, (v3, i3) -> {of('slice(bs, 1, i3)')})", "bo", inner))))


def _proposals(generator: str, t: str = "t") -> str:
    """SQL: the array of a generator's proposals in column ``t``."""
    kind, quick, pattern, check, _ = GENERATORS[generator]
    r = _literal(pattern)
    before = f"right(get(mp.p, i), {_BEFORE})"
    known = check.replace("b rlike NAMED", f"{before} rlike {_literal(_NAMED + '$')}").replace("b rlike", f"{before} rlike")
    gaps = "transform(mp.m, (v0, i0) -> CAST(length(get(mp.p, i0)) + IF(i0 > 0, length(get(mp.m, i0 - 1)), 0) AS BIGINT))"
    one = f"""transform(mp.m, (v, i) -> named_struct('kind', {kind}, 'gen', {list(GENERATORS).index(generator)}, 's', get(st, i), 'e', get(st, i) + length(v), 'v', v, 'ok', CAST({known} AS BOOLEAN),
      'before', {before}, 'after', left(get(mp.p, i + 1), {_AFTER})))"""
    found = _let(f"named_struct('m', regexp_extract_all({t}, {r}, 0), 'p', split({t}, {r}, -1))", "mp", _let(_running(gaps), "st", one))
    return f"CASE WHEN {t} rlike {_literal(quick)} THEN {found} END"


def _all(generators, t: str = "t") -> str:
    """SQL: the proposals of several generators in one array."""
    return f"flatten(array({', '.join(f'coalesce({_proposals(g, t)}, array())' for g in generators)}))"


def _touched(spans: str, by: str) -> str:
    """SQL: ``spans`` (structs with s, e), sorted by s, with ``hit``: whether one of the spans ``by`` overlaps it."""
    rows = f"array_sort(concat(transform({spans}, z1 -> named_struct('s', z1.s, 'own', 1, 'e', z1.e, 'x', z1)), transform({by}, z2 -> named_struct('s', z2.s, 'own', 0, 'e', z2.e, 'x', get({spans}, 0)))))"
    ends = _running("transform(rw, z3 -> IF(z3.own = 0, z3.e, 0L))", _most, False)
    far = 1 << 62  # starts after a span, counted down from here, so that their least is a running maximum from the end
    starts = f"reverse({_running(f'transform(reverse(rw), z4 -> IF(z4.own = 0, {far}L - z4.s, 0L))', _most, False)})"
    marked = _let(ends, "pe", _let(starts, "ps", f"transform(rw, (z5, i5) -> named_struct('own', z5.own, 'x', z5.x, 'hit', pe[i5] > z5.s OR ps[i5] > {far}L - z5.e))"))
    return _let(rows, "rw", f"filter({marked}, z6 -> z6.own = 1)")


FEATURES = {
    "gen": "x.gen",
    "digits": "least(length(regexp_replace(x.v, '[^0-9]', '')), 20)",
    "marks": "least(length(regexp_replace(x.v, '[A-Za-z0-9]', '')), 8)",
    "letters": "least(length(regexp_replace(x.v, '[^A-Za-z]', '')) div 4, 6)",
    "length": "least(length(x.v) div 4, 12)",
    "turns": "least(length(regexp_replace(x.v, '(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])', '#')) - length(x.v), 6)",
    "left": "CASE WHEN x.before rlike '[A-Za-z0-9]$' THEN 2 WHEN x.before rlike '[^ \\\\s]$' THEN 1 ELSE 0 END",
    "right": "CASE WHEN x.after rlike '^[A-Za-z0-9]' THEN 2 WHEN x.after rlike '^[^ \\\\s]' THEN 1 ELSE 0 END",
    "cue": f"IF(lower(x.before) rlike {_literal(_CUES)}, 1, 0)",
    "named": f"CASE WHEN x.before rlike {_literal(_NAMED + '$')} THEN 2 WHEN x.before rlike {_literal('(?i:pass|pwd|secret|token|key)')} THEN 1 ELSE 0 END",
    "near": "least(length(regexp_replace(concat(x.before, x.after), '[^0-9]', '')) div 3, 4)",
    "bracket": "IF(x.v rlike '[(]', 1, 0)",
    "dull": "IF(regexp_replace(x.v, '[^0-9]', '') rlike '^([0-9])\\\\1+$', 1, 0)",
}


@dataclass
class Booster:
    """Trees of depth two over small integer features: (feature, cut, low branch, high branch) or a leaf.

    ``by_generator`` has the calibrated thresholds; any other loose generator's is its kind's, infinite where it adds nothing.
    """

    trees: list[tuple]
    bias: float
    thresholds: list[float]
    by_generator: dict[str, float] = field(default_factory=dict)

    def threshold(self, generator: str) -> float:
        kind = GENERATORS[generator][0]
        return self.by_generator.get(generator, self.thresholds[kind] if kind < len(self.thresholds) else float("inf"))

    def sql(self) -> str:
        """Log odds of a proposal's feature struct ``f``."""

        def tree(t) -> str:
            if isinstance(t, float):
                return f"{t!r}D"
            name, cut, low, high = t
            return f"IF(f.{name} <= {cut}, {tree(low)}, {tree(high)})"

        return " + ".join([f"{self.bias!r}D", *(tree(t) for t in self.trees)])

    def score(self, x: np.ndarray) -> np.ndarray:
        names = list(FEATURES)

        def tree(t, rows):
            if isinstance(t, float):
                return np.full(len(rows), t)
            name, cut, low, high = t
            return np.where(rows[:, names.index(name)] <= cut, tree(low, rows), tree(high, rows))

        return self.bias + sum((tree(t, x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 40, rate: float = 0.3, ridge: float = 2.0) -> tuple[list[tuple], float]:
    """Second-order boosting of logistic loss over feature vectors with counts ``n``."""
    names = list(FEATURES)
    p0 = (n[y == 1].sum() + 1) / (n.sum() + 2)
    f = np.full(len(x), bias := float(np.log(p0 / (1 - p0))))
    cuts = [(j, c) for j in range(x.shape[1]) for c in np.unique(x[:, j])[:-1]]

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        def gain(r):
            return g[r].sum() ** 2 / (h[r].sum() + ridge)

        best = max(((gain(rows & (x[:, j] <= c)) + gain(rows & (x[:, j] > c)) - gain(rows), j, c) for j, c in cuts), default=None) if depth else None
        if best is None or best[0] < 1e-6:
            return float(-rate * g[rows].sum() / (h[rows].sum() + ridge))
        _, j, c = best
        return (names[j], int(c), split(rows & (x[:, j] <= c), g, h, depth - 1), split(rows & (x[:, j] > c), g, h, depth - 1))

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        t = split(np.ones(len(x), bool), n * (p - y), n * p * (1 - p), 2)
        trees.append(t)
        f = f + Booster([t], 0.0, []).score(x)
    return trees, bias


def labelled(documents: DataFrame) -> DataFrame:
    """The proposals of all texts that something is known of: aside (held out for the thresholds), ok and x, a proposal.

    Strict proposals and loose ones whose format or name tells; loose ones that a
    verified span of another kind overlaps (not ok); loose forms in altered texts
    that had none of the kind before (ok).
    """
    t = documents.select(F.col("text").cast("string").alias("t")).where(F.expr("t IS NOT NULL AND t rlike '[0-9@(\\\\[=:]'"))
    strict = [g for g, x in GENERATORS.items() if x[4]]
    found = t.select("t", F.expr("pmod(xxhash64(t), 2) = 0").alias("aside"), F.expr(_all(strict)).alias("strict"), F.expr(_all(LOOSE)).alias("loose"))
    found = found.where("size(strict) + size(loose) > 0")
    parts = ["transform(filter(concat(strict, loose), x -> x.ok IS NOT NULL), x -> named_struct('ok', x.ok, 'x', x))"]
    for kind in sorted({GENERATORS[g][0] for g in LOOSE}):
        found = found.withColumn(f"own{kind}", F.expr(f"filter(loose, x -> x.kind = {kind} AND x.ok IS NULL)"))
        found = found.withColumn(f"other{kind}", F.expr(f"IF(size(own{kind}) = 0, array(), filter(strict, x -> x.kind <> {kind} AND x.ok))"))
        inside = f"transform(filter({_touched(f'own{kind}', f'other{kind}')}, x -> x.hit), x -> named_struct('ok', false, 'x', x.x))"
        found = found.withColumn(f"inside{kind}", F.expr(f"CASE WHEN size(other{kind}) > 0 THEN {inside} END"))
        parts.append(f"coalesce(inside{kind}, array())")
    forms = ["spelled_email", "bare_phone"]
    changed = "t"
    for pattern, to in ALTERED:
        changed = f"regexp_replace({changed}, {_literal(pattern)}, {_literal(to)})"
    numbers = ", ".join(str(list(GENERATORS).index(g)) for g in forms)
    fresh = f"exists(strict, x -> x.ok AND x.kind IN (0, 3)) AND NOT exists(loose, x -> x.gen IN ({numbers}) AND x.kind = 0)"
    found = found.withColumn("altered", F.expr(f"CASE WHEN {fresh} THEN {changed} END"))
    parts.append(f"IF(altered IS NULL, array(), transform({_all(forms, 'altered')}, x -> named_struct('ok', true, 'x', x)))")
    return found.select("aside", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("r")).select("aside", "r.ok", "r.x")


def train(documents: DataFrame, precision: float = 0.99, least: int = 20) -> Booster:
    """Counts the labelled proposals of all texts by features, fits the trees on one half of the texts and calibrates the loose generators' thresholds on the other."""
    counted = labelled(documents).select("aside", F.expr("CAST(ok AS INT)").alias("y"), *(F.expr(f"CAST({sql} AS INT)").alias(f"f_{name}") for name, sql in FEATURES.items())).groupBy("aside", "y", *(f"f_{n}" for n in FEATURES)).count().collect()
    never = [float("inf")] * 4
    counted = sorted(counted, key=tuple)
    a = np.array([list(r) for r in counted], dtype=float).reshape(len(counted), len(FEATURES) + 3)
    learn = a[:, 0] == 0 if len(a) else np.zeros(0, bool)
    if not learn.any() or len(set(a[learn, 1])) < 2:
        return Booster([], 0.0, never)
    trees, bias = boost(a[learn, 2:-1], a[learn, 1], a[learn, -1])
    model = Booster(trees, bias, never)
    s = model.score(a[:, 2:-1])
    for g, name in enumerate(GENERATORS):
        own = (a[:, 2] == g) & ~learn
        for cut in sorted(set(s[own])) if name in LOOSE else ():
            above = own & (s >= cut)
            good, all_ = a[above & (a[:, 1] == 1), -1].sum(), a[above, -1].sum()
            if all_ >= least and good >= precision * all_:
                model.by_generator[name] = float(cut)
                break
    return model


def _best(spans: str) -> str:
    """SQL: of ``spans`` (structs with s, e, kind, m, sorted by s) those that no kept better one overlaps.

    Spans are taken from the largest m down, equal ones from the left, longer ones first; one
    is kept if it overlaps none kept before, so a dropped span always touches a kept one.
    Only spans of one unbroken run of overlaps are compared.
    """
    ends = _running(f"transform({spans}, z -> z.e)", _most, False)
    firsts = _let(ends, "far", f"filter(sequence(0, size({spans}) - 1), p -> p = 0 OR get(far, p) <= get({spans}, p).s)")
    runs = _let(firsts, "at", f"transform(at, (p, i) -> slice({spans}, p + 1, coalesce(get(at, i + 1), size({spans})) - p))")
    order = "array_sort(transform(run, z -> named_struct('less', -z.m, 's', z.s, 'back', -z.e, 'kind', z.kind, 'x', z)))"
    kept = f"aggregate(transform({order}, z -> z.x), slice(run, 1, 0), (got, x) -> IF(exists(got, y -> y.s < x.e AND x.s < y.e), got, concat(got, array(x))))"
    return f"IF(size({spans}) < 2, {spans}, flatten(transform({runs}, run -> IF(size(run) = 1, run, {kept}))))"


_SPOTS = "ARRAY<STRUCT<kind: INT, s: BIGINT, e: BIGINT>>"


def _marked(documents: DataFrame, model: Booster, name: str) -> DataFrame:
    """The documents with a struct of ``base`` and ``added`` spans; no column's name may begin with ``name``."""
    t, base, cand, free = (f"{name}_{k}" for k in ("text", "base", "cand", "free"))
    bare = "transform({}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))"
    strict = [g for g, x in GENERATORS.items() if x[4]]
    out = documents.withColumn(t, F.expr("coalesce(CAST(text AS STRING), '')"))
    out = out.withColumn(base, F.expr(f"CAST(IF({t} rlike '[0-9@]', {bare.format(f'filter({_all(strict, t)}, x -> x.ok)')}, array()) AS {_SPOTS})"))
    open_ = [g for g in LOOSE if np.isfinite(model.threshold(g))]
    if not open_:
        return out.withColumn(name, F.expr(f"named_struct('base', {base}, 'added', CAST(array() AS {_SPOTS}))")).drop(t, base)
    cuts = " ".join(f"WHEN {k} THEN {model.threshold(g)!r}D" for k, g in enumerate(GENERATORS) if g in open_)
    features = ", ".join(f"'{n}', {sql}" for n, sql in FEATURES.items())
    margin = _let(f"named_struct({features})", "f", f"{model.sql()} - CASE f.gen {cuts} ELSE double('Infinity') END")
    out = out.withColumn(cand, F.expr(f"filter({_all(open_, t)}, x -> coalesce(x.ok, true))"))
    out = out.withColumn(cand, F.expr(f"filter(transform({cand}, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind, 'm', {margin})), x -> x.m >= 0)"))
    out = out.withColumn(free, F.expr(f"IF(size({cand}) = 0, {cand}, transform(filter({_touched(cand, base)}, x -> NOT x.hit), x -> x.x))"))
    best = _best(free)
    return out.withColumn(name, F.expr(f"named_struct('base', {base}, 'added', CAST(array_sort({bare.format(best)}) AS {_SPOTS}))")).drop(t, base, cand, free)


def _free(documents: DataFrame) -> str:
    """A name that no column of documents begins with."""
    name = "__pii"
    while any(c.lower().startswith(name) for c in documents.columns):
        name += "x"
    return name


def spans(documents: DataFrame, model: Booster) -> DataFrame:
    """All columns of documents with ``__base`` and ``__added`` (in place of columns that have these names): arrays of (kind, s, e) by kind, then start, in code points, end exclusive."""
    name = _free(documents)
    return _marked(documents, model, name).withColumns({"__base": F.col(f"{name}.base"), "__added": F.col(f"{name}.added")}).drop(name)


def text_of(column: str) -> str:
    """SQL: spans as ``kind:start:end``, by kind and start, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({column}), x -> concat(element_at(array({names}), x.kind + 1), ':', x.s, ':', x.e)), ',')"


CUT = 1024  # texts are cut at so many code points, so that a place is found without a walk from the text's start


def _between(ch: str, a: str, b: str) -> str:
    """SQL: the code points from ``a`` to ``b`` of the text whose cuts are ``ch``."""
    i, j = f"CAST({a} div {CUT} AS INT)", f"CAST(({b} - 1) div {CUT} AS INT)"
    first = f"substr(get({ch}, {i}), CAST({a} % {CUT} + 1 AS INT)"
    return f"""CASE WHEN {b} <= {a} THEN '' WHEN {i} = {j} THEN {first}, CAST({b} - {a} AS INT))
      ELSE concat({first}), array_join(slice({ch}, {i} + 2, {j} - {i} - 1), ''), substr(get({ch}, {j}), 1, CAST(({b} - 1) % {CUT} + 1 AS INT))) END"""


def redact(documents: DataFrame, model: Booster) -> DataFrame:
    """The documents with every span's text replaced by its kind in angle brackets; overlapping spans give one mark, of the first."""
    name = _free(documents)
    sp, far, ch = (f"{name}_{k}" for k in ("spans", "far", "cuts"))
    out = _marked(documents, model, name).coalesce(tasks_for(documents))
    out = out.withColumn(sp, F.expr(f"array_sort(transform(concat({name}.base, {name}.added), x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"))
    out = out.withColumn(far, F.expr(_running(f"transform({sp}, x -> x.e)", _most, False))).withColumn(ch, F.expr(f"IF(size({sp}) = 0, array(), regexp_extract_all(text, '(?s).{{1,{CUT}}}', 0))"))
    names = ", ".join(f"'<{k}>'" for k in KINDS)
    gaps = f"transform({sp}, (x, i) -> IF(x.s >= {far}[i], concat({_between(ch, f'{far}[i]', 'x.s')}, element_at(array({names}), x.kind + 1)), ''))"
    last = _let(_most(f"transform({sp}, x -> x.e)"), "la", _let("CAST(length(text) AS BIGINT)", "n", _between(ch, "la", "n")))
    out = out.withColumn("text", F.expr(f"IF(size({sp}) = 0, text, concat(array_join({gaps}, ''), {last}))")).drop(name, sp, far, ch)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*documents.columns) if "n_chars" in documents.columns else out.select(*documents.columns)
