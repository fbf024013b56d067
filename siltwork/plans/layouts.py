"""Queries of page layout and books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import books as bk
from ..operators import folds, quality
from ..operators import layouts as op
from ..operators import stories as st
from . import dimensions as dim
from . import stories as st_plan
from .clusters import RECURSIVE, chapter_rows, spreads_sql
from .functions import fit_sql
from .registry import query
from .views import WITH, photos, table

_T1 = ("0.025::DOUBLE", "0.05::DOUBLE", "0.436::DOUBLE")
_H = "0.81::DOUBLE"


def _two_sql(a: str, b: str, h: float, x: str = "0.025::DOUBLE") -> str:
    """DuckDB: struct of both layouts' boxes of two photos on a page of height h."""
    g, hh = "0.018::DOUBLE", (h - 0.018) / 2.0
    net = 0.436 - 0.018
    w1 = f"greatest({net * 0.25!r}::DOUBLE, least({net * 0.75!r}::DOUBLE, {net!r}::DOUBLE * ({a} / greatest(0.1::DOUBLE, {a} + {b}))))"
    y2 = f"{0.05 + hh + 0.018!r}::DOUBLE"
    return f"""a1 := {fit_sql(a, x, '0.05::DOUBLE', '0.436::DOUBLE', f'{hh!r}::DOUBLE')}, a2 := {fit_sql(b, x, y2, '0.436::DOUBLE', f'{hh!r}::DOUBLE')},
      b1 := {fit_sql(a, x, '0.05::DOUBLE', w1, f'{h!r}::DOUBLE')}, b2 := {fit_sql(b, f'({x} + {w1} + {g})', '0.05::DOUBLE', f'({net!r}::DOUBLE - {w1})', f'{h!r}::DOUBLE')}"""


_PAIRS = f"""pairs AS (SELECT x.photo_id, x.aspect AS a, y.aspect AS b FROM photos x JOIN photos y ON y.photo_id = x.photo_id + 1 WHERE x.photo_id % 2 = 0),
  boxed AS (SELECT photo_id, a, b, struct_pack({_two_sql('a', 'b', fn.safe_bounds(True, True)[3])}) AS s FROM pairs),
  chosen AS (SELECT *, a < 1.05::DOUBLE OR b < 1.05::DOUBLE OR NOT (a >= 1.1::DOUBLE AND b >= 1.1::DOUBLE) OR s.b1.w * s.b1.h + s.b2.w * s.b2.h > (s.a1.w * s.a1.h + s.a2.w * s.a2.h) * 0.95::DOUBLE AS beside FROM boxed)"""


def _pairs(spark, d):
    p = photos(spark, d).select("photo_id", "aspect")
    n = p.select((F.col("photo_id") - 1).alias("photo_id"), F.col("aspect").alias("b"))
    return p.where("photo_id % 2 = 0").join(n, "photo_id").withColumnRenamed("aspect", "a")


@query(f"{WITH}, {_PAIRS} SELECT photo_id, CASE WHEN beside THEN 'side' ELSE 'stack' END AS mode, CASE WHEN beside THEN s.b1.w ELSE s.a1.w END AS w1, CASE WHEN beside THEN s.b1.h ELSE s.a1.h END AS h1, CASE WHEN beside THEN s.b2.w ELSE s.a2.w END AS w2, CASE WHEN beside THEN s.b2.h ELSE s.a2.h END AS h2 FROM chosen")
def q_page_layout(spark, d):
    """Two photos on a left page with text."""
    p = _pairs(spark, d).select("photo_id", op.page(F.array("a", "b"), op.area_of(True, True, False)).alias("p"))
    one, two = F.col("p")[0], F.col("p")[1]
    return p.select("photo_id", F.when(one["y"] == two["y"], "side").otherwise("stack").alias("mode"), one["w"].alias("w1"), one["h"].alias("h1"), two["w"].alias("w2"), two["h"].alias("h2"))


@query(f"{WITH}, {_PAIRS} SELECT photo_id, round(CASE WHEN beside THEN s.b1.w * s.b1.h + s.b2.w * s.b2.h ELSE s.a1.w * s.a1.h + s.a2.w * s.a2.h END, 5) AS area FROM chosen")
def q_slot_area(spark, d):
    p = _pairs(spark, d).select("photo_id", op.page(F.array("a", "b"), op.area_of(True, True, False)).alias("p"))
    return p.select("photo_id", F.round(F.aggregate("p", F.lit(0.0), lambda s, b: s + b["w"] * b["h"]), 5).alias("area"))


def _spread2_sql() -> str:
    left, right = fit_sql("a", "0.025::DOUBLE", "0.05::DOUBLE", "0.436::DOUBLE", f"{fn.safe_bounds(True, True)[3]!r}::DOUBLE"), fit_sql("b", "0.539::DOUBLE", "0.05::DOUBLE", "0.436::DOUBLE", f"{fn.safe_bounds(True, False)[3]!r}::DOUBLE")
    swapped_l, swapped_r = left.replace("> a", "> b").replace("* a", "* b").replace("/ a", "/ b"), right.replace("> b", "> a").replace("* b", "* a").replace("/ b", "/ a")
    return f"SELECT photo_id, a, b, {left} AS l0, {right} AS r0, {swapped_l} AS l1, {swapped_r} AS r1 FROM pairs"


@query(
    f"""{WITH}, {_PAIRS}, f AS ({_spread2_sql()}), s AS (SELECT *, l0.w * l0.h + r0.w * r0.h + CASE WHEN a >= 1.1::DOUBLE AND b <= 0.95::DOUBLE OR a <= 0.95::DOUBLE AND b >= 1.1::DOUBLE THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS s0,
    l1.w * l1.h + r1.w * r1.h + CASE WHEN a >= 1.1::DOUBLE AND b <= 0.95::DOUBLE OR a <= 0.95::DOUBLE AND b >= 1.1::DOUBLE THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS s1 FROM f) SELECT photo_id, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS best, round(greatest(s0, s1), 6) AS score FROM s"""
)
def q_best_split(spark, d):
    """Which of two photos goes left on a spread with text."""
    rows = _pairs(spark, d).withColumn("ars", F.array("a", "b"))
    return op.best_split(rows, True).select("photo_id", "best", F.round("score", 6).alias("score"))


@query(
    f"""{WITH}, b AS (SELECT photo_id, width AS w, height AS h, width // 2 AS hw, height // 2 AS hh, CAST(floor(width * 0.15::DOUBLE) AS BIGINT) AS ow, CAST(floor(height * 0.15::DOUBLE) AS BIGINT) AS oh FROM photos)
    SELECT photo_id, 0 AS x, 0 AS y, w, h FROM b UNION ALL SELECT photo_id, 0, 0, hw + ow, hh + oh FROM b WHERE greatest(w, h) >= 800 UNION ALL SELECT photo_id, hw - ow, 0, w - hw + ow, hh + oh FROM b WHERE greatest(w, h) >= 800
    UNION ALL SELECT photo_id, 0, hh - oh, hw + ow, h - hh + oh FROM b WHERE greatest(w, h) >= 800 UNION ALL SELECT photo_id, hw - ow, hh - oh, w - hw + ow, h - hh + oh FROM b WHERE greatest(w, h) >= 800"""
)
def q_tiles(spark, d):
    return photos(spark, d).select("photo_id", F.explode(op.tiles(F.col("width"), F.col("height"))).alias("t")).select("photo_id", "t.x", "t.y", "t.w", "t.h")


_SW, _SH, _B = f"{200.0 * op.MM * 2.0!r}::DOUBLE", f"{200.0 * op.MM!r}::DOUBLE", f"{3.0 * op.MM!r}::DOUBLE"


@query(
    f"""{WITH}, s AS (SELECT photo_id, aspect, (photo_id % 50) / 100.0::DOUBLE AS x, (photo_id % 40) / 100.0::DOUBLE AS y, (10 + photo_id % 30) / 100.0::DOUBLE AS w, (10 + photo_id % 45) / 100.0::DOUBLE AS h FROM photos),
    p AS (SELECT photo_id, aspect, {_B} + x * {_SW} AS l, greatest(5.0::DOUBLE, w * {_SW}) AS bw, greatest(5.0::DOUBLE, h * {_SH}) AS bh, y FROM s), q AS (SELECT *, ({_SH} + 2.0::DOUBLE * {_B}) - ({_B} + y * {_SH}) - bh AS bt FROM p)
    SELECT photo_id, round(l, 4) AS x, round(bt, 4) AS y, round(CASE WHEN aspect > bw / bh THEN bh * aspect ELSE bw END, 4) AS rw, round(CASE WHEN aspect > bw / bh THEN bh ELSE bw / aspect END, 4) AS rh FROM q"""
)
def q_pdf_geometry(spark, d):
    i = F.col("photo_id")
    g = op.points(i % 50 / 100, i % 40 / 100, (10 + i % 30) / 100, (10 + i % 45) / 100, F.col("aspect"))
    return photos(spark, d).select("photo_id", g.alias("g")).select("photo_id", F.round("g.x", 4).alias("x"), F.round("g.y", 4).alias("y"), F.round("g.rw", 4).alias("rw"), F.round("g.rh", 4).alias("rh"))


_TPL = dim.values([(t, n, k) for k, (t, n) in enumerate(dim.TEMPLATES.items())], "template, photo_count, seq")


@query(
    f"""WITH c AS (SELECT c_custkey, CAST(1 + c_custkey % 6 AS INTEGER) AS n, c_custkey % 7 AS used FROM customer), x AS (SELECT c_custkey, template, seq, abs(photo_count - n) AS off, seq = used AS was FROM c, {_TPL}),
    m AS (SELECT *, min(off) OVER (PARTITION BY c_custkey) AS least FROM x), k AS (SELECT *, bool_or(NOT was) OVER (PARTITION BY c_custkey) AS fresh FROM m WHERE least = 0 AND off = 0 OR least > 0),
    r AS (SELECT c_custkey, template, row_number() OVER (PARTITION BY c_custkey ORDER BY off, seq) AS rn FROM k WHERE NOT was OR NOT fresh) SELECT c_custkey, template FROM r WHERE rn = 1"""
)
def q_template_match(spark, d):
    """Templates of the wanted count, or all by nearness, unused ones first if there are any: over the fixed list in one expression."""
    seqs = [F.struct(F.lit(n).alias("n"), F.lit(k).alias("seq"), F.lit(t).alias("t")) for k, (t, n) in enumerate(dim.TEMPLATES.items())]
    n, used = (1 + F.col("c_custkey") % 6).cast("int"), (F.col("c_custkey") % 7).cast("int")
    c = table(spark, d, "customer").select("c_custkey", n.alias("n"), used.alias("used"), F.array(*seqs).alias("all"))
    c = c.withColumn("exact", F.filter("all", lambda t: t["n"] == F.col("n"))).withColumn("pool", F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("all")))
    c = c.withColumn("fresh", F.filter("pool", lambda t: t["seq"] != F.col("used"))).withColumn("pick", F.when(F.size("fresh") > 0, F.col("fresh")).otherwise(F.col("pool")))
    best = F.array_min(F.transform("pick", lambda t: F.struct(F.abs(t["n"] - F.col("n")).alias("off"), t["seq"].alias("seq"), t["t"].alias("t"))))
    return c.select("c_custkey", best["t"].alias("template"))


_THEMES = dim.values([(c, *([*t, "Minimal", "Editorial"][:3])) for c, t in dim.THEMES.items()], "category, t1, t2, t3")
_FONTS = dim.values([(c, *f) for c, f in dim.FONTS.items()], "category, heading, body")


@query(
    f"""WITH c AS (SELECT c_custkey, c_name, ['Memories', 'Celebration', 'Travel', 'Portraits', 'Milestones', 'Family'][CAST(c_custkey % 6 AS INTEGER) + 1] AS category FROM customer),
    t AS (SELECT * FROM {_THEMES}), f AS (SELECT * FROM {_FONTS}), p AS (SELECT c_custkey, c_name, c.category, unnest([1, 2, 3]) AS variation, unnest([t1, t2, t3]) AS theme FROM c JOIN t ON c.category = t.category)
    SELECT c_custkey, p.category, variation, theme, coalesce(heading, 'Merriweather') AS heading, CASE variation WHEN 1 THEN upper(c_name) WHEN 2 THEN 'CHRONICLES OF ' || upper(c_name) ELSE 'DAYTIME UNFOLDED' END AS cover_title FROM p LEFT JOIN f ON p.category = f.category"""
)
def q_theme_batch(spark, d):
    """A category's first three themes as three variations with fonts and titles."""
    cats = ["Memories", "Celebration", "Travel", "Portraits", "Milestones", "Family"]
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.element_at(F.array(*map(F.lit, cats)), (F.col("c_custkey") % 6 + 1).cast("int")).alias("category"))
    three = F.slice(F.concat("themes", F.array(F.lit("Minimal"), F.lit("Editorial"))), 1, 3)
    v = c.join(F.broadcast(dim.themes(spark)), "category").select("c_custkey", "c_name", "category", F.posexplode(three).alias("k", "theme"))
    v = v.join(F.broadcast(dim.fonts(spark)), "category", "left").withColumn("variation", F.col("k") + 1)
    title = F.when(F.col("variation") == 1, F.upper("c_name")).when(F.col("variation") == 2, F.concat(F.lit("CHRONICLES OF "), F.upper("c_name"))).otherwise("DAYTIME UNFOLDED")
    return v.select("c_custkey", "category", "variation", "theme", F.coalesce("heading", F.lit("Merriweather")).alias("heading"), title.alias("cover_title"))


_PALETTES = dim.values([(t, *c) for t, c in dim.PALETTES.items()], "theme, background, surface, main, accent, ink")


@query(
    f"""WITH t AS (SELECT category, unnest([t1, t2, t3]) AS theme, unnest([1, 2, 3]) AS variation FROM {_THEMES}), p AS (SELECT * FROM {_PALETTES}), c AS (SELECT c_custkey, ['Memories', 'Celebration', 'Travel', 'Portraits', 'Milestones', 'Family'][CAST(c_custkey % 6 AS INTEGER) + 1] AS category FROM customer)
    SELECT c_custkey, variation, t.theme, background, main, CASE WHEN list_sum([('0x' || substr(background, 2 + 2 * k, 2))::INTEGER * [299, 587, 114][k + 1] FOR k IN [0, 1, 2]]) / 1000 >= 128 THEN '#121212' ELSE '#FFFFFF' END AS ink FROM c JOIN t USING (category) JOIN p USING (theme)"""
)
def q_variation_palettes(spark, d):
    """The colours of a customer's three variations, and the text colour that reads on their background."""
    cats = ["Memories", "Celebration", "Travel", "Portraits", "Milestones", "Family"]
    c = table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, cats)), (F.col("c_custkey") % 6 + 1).cast("int")).alias("category"))
    three = F.slice(F.concat("themes", F.array(F.lit("Minimal"), F.lit("Editorial"))), 1, 3)
    v = c.join(F.broadcast(dim.themes(spark)), "category").select("c_custkey", F.posexplode(three).alias("k", "theme"))
    v = v.join(F.broadcast(dim.palettes(spark)), "theme")
    part = lambda at: F.conv(F.substring("background", at, 2), 16, 10).cast("int")
    return v.select("c_custkey", (F.col("k") + 1).alias("variation"), "theme", "background", F.col("primary").alias("main"), fn.text_colour(part(2), part(4), part(6)).alias("ink"))


@query("SELECT l_suppkey, count(DISTINCT sig) AS structures FROM (SELECT l_suppkey, l_partkey, list(l_linenumber ORDER BY l_orderkey, l_linenumber) AS sig FROM lineitem GROUP BY l_suppkey, l_partkey) GROUP BY l_suppkey")
def q_signature(spark, d):
    """Distinct structures: the ordered counts of each group as one value."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("a"))
    s = s.select("l_suppkey", F.transform("a", lambda x: x["l_linenumber"]).alias("sig"))
    return s.groupBy("l_suppkey").agg(F.count_distinct("sig").alias("structures"))


SIZES = (3, 2, 4)  # photos of a spread, by variation


def book_spreads(spark, d, *variations: int):
    """Spreads of the variations (numbered from 0): photos in order, a running number and its caption. Chapters are made once for all; from there on a session's rows stay in one task."""
    rows = chapter_rows(spark, d, "width", "height")
    g = folds.spread_groups(rows, ["session_id", "chapter"], tuple(SIZES[k] for k in variations), ["photo_id", "aspect", "width", "height"])
    book = Window.partitionBy("session_id", "size")
    g = g.withColumn("spread_idx", F.row_number().over(book.orderBy("chapter", "spread"))).withColumn("chapters", F.max("chapter").over(book))
    g = g.withColumn("variation", F.array_position(F.array(*map(F.lit, SIZES)), F.col("size")).cast("int"))
    caps = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in dim.CAPTIONS)), F.col("variation"))
    last = F.col("chapter") == F.col("chapters")
    title = F.concat(F.lit("CHAPTER "), "chapter", F.when(last, ": HIGHLIGHTS").otherwise(": STORY SEQUENCE"))
    caption = F.when((F.col("spread") == 0) & (F.col("chapters") > 1), title).otherwise(F.element_at(caps, (F.pmod(F.col("spread_idx") - 1, F.lit(4)) + 1).cast("int")))
    return g.select("session_id", "chapter", "variation", "spread_idx", caption.alias("caption"), F.lit(True).alias("has_text"), "photos")


def _texts(rows) -> str:
    return "[" + ", ".join(f"'{t}'" for t in rows) + "]"


def slots_sql(*variations: int, seed: int = 0) -> str:
    """CTEs up to ``slots``: every slot of the variations' spreads, by trying all splits and both ways of two photos on a page."""
    ways = ", ".join(f"({n}, {k}, {list(a)}::BIGINT[], {list(b)}::BIGINT[])" for n in range(1, op.MOST_PHOTOS + 1) for k, (a, b) in enumerate(op.splits(n)))
    x, y, w, gap, net = ("0.025::DOUBLE", "0.539::DOUBLE"), "0.05::DOUBLE", "0.436::DOUBLE", "0.018::DOUBLE", f"{0.436 - 0.018!r}::DOUBLE"
    tall = [f"{fn.safe_bounds(True, t)[3]!r}::DOUBLE" for t in (True, False)]
    area = lambda b: f"{b}.w * {b}.h"
    variation = "CASE size " + " ".join(f"WHEN {n} THEN {k + 1}" for k, n in enumerate(SIZES)) + " END"
    caps = "[" + ", ".join(_texts(c) for c in dim.CAPTIONS) + "]"
    box = lambda x, y, b: f"struct_pack(x := {x}, y := {y}, w := {b}.w, h := {b}.h)"
    return f"""{RECURSIVE}, {spreads_sql(*(SIZES[k] for k in variations))},
    book AS (SELECT session_id, chapter, size, spread, list(struct_pack(id := photo_id, a := aspect, pw := width, ph := height) ORDER BY pos) AS ps FROM placed JOIN gg USING (session_id, chapter, i) GROUP BY ALL),
    numbered AS (SELECT *, {variation} AS variation, row_number() OVER (PARTITION BY session_id, size ORDER BY chapter, spread) AS spread_idx, max(chapter) OVER (PARTITION BY session_id, size) AS chapters FROM book),
    flagged AS (SELECT *, CASE WHEN spread = 0 AND chapters > 1 THEN concat('CHAPTER ', chapter, CASE WHEN chapter = chapters THEN ': HIGHLIGHTS' ELSE ': STORY SEQUENCE' END) ELSE {caps}[variation][CAST((spread_idx - 1) % 4 AS INTEGER) + 1] END AS caption,
      CASE variation WHEN 1 THEN false WHEN 2 THEN true ELSE (spread_idx + {seed}) % 2 <> 0 END AS left_big, CASE variation WHEN 3 THEN (spread_idx + {seed}) % 2 = 0 ELSE false END AS right_big FROM numbered),
    pages AS (SELECT session_id, chapter, variation, spread_idx, caption, ps, k, unnest([0, 1]) AS sd, unnest([lefts, rights]) AS own, unnest([left_big, right_big]) AS big FROM flagged JOIN (VALUES {ways}) t(n, k, lefts, rights) ON n = len(ps)),
    geo AS (SELECT *, ps[own[1] + 1].a AS a, ps[own[2] + 1].a AS b, CASE sd WHEN 0 THEN {x[0]} ELSE {x[1]} END AS px, CASE sd WHEN 0 THEN {tall[0]} ELSE {tall[1]} END AS ph FROM pages),
    halves AS (SELECT *, CASE WHEN big THEN (ph - {gap}) * 0.60::DOUBLE ELSE (ph - {gap}) / 2.0::DOUBLE END AS h1, CASE WHEN big THEN (ph - {gap}) - (ph - {gap}) * 0.60::DOUBLE ELSE (ph - {gap}) / 2.0::DOUBLE END AS h2,
      greatest({net} * 0.25::DOUBLE, least({net} * 0.75::DOUBLE, {net} * (a / greatest(0.1::DOUBLE, a + b)))) AS w1 FROM geo),
    fits AS (SELECT *, {fit_sql('a', 'px', y, w, 'ph')} AS one, {fit_sql('a', 'px', y, w, 'h1')} AS a1, {fit_sql('b', 'px', f'({y} + h1 + {gap})', w, 'h2')} AS a2, {fit_sql('a', 'px', y, 'w1', 'ph')} AS b1, {fit_sql('b', f'(px + w1 + {gap})', y, f'({net} - w1)', 'ph')} AS b2 FROM halves),
    laid AS (SELECT *, CASE len(own) WHEN 0 THEN [] WHEN 1 THEN [{box('one.x', 'one.y', 'one')}] ELSE CASE WHEN least(a, b) < 1.1::DOUBLE OR {area('b1')} + {area('b2')} > ({area('a1')} + {area('a2')}) * 0.95::DOUBLE
      THEN [{box('b1.x', 'least(b1.y, b2.y)', 'b1')}, {box('b2.x', 'least(b1.y, b2.y)', 'b2')}]
      ELSE [{box('a1.x', f'{y} + (ph - (a1.h + {gap} + a2.h)) / 2.0::DOUBLE', 'a1')}, {box('a2.x', f'{y} + (ph - (a1.h + {gap} + a2.h)) / 2.0::DOUBLE + a1.h + {gap}', 'a2')}] END END AS boxes FROM fits),
    scored AS (SELECT session_id, variation, spread_idx, k, sum(coalesce(list_sum([z.w * z.h FOR z IN boxes]), 0)) + CASE WHEN min(len(own)) = 1 AND max(len(own)) = 1 AND min(a) <= 0.95::DOUBLE AND max(a) >= 1.1::DOUBLE THEN 0.25::DOUBLE ELSE 0 END AS score FROM laid GROUP BY ALL),
    best AS (SELECT session_id, variation, spread_idx, arg_max(k, struct_pack(s := score, k := -k)) AS k FROM scored GROUP BY ALL),
    spots AS (SELECT session_id, chapter, variation, spread_idx, caption, sd, ps, unnest(own) AS photo, unnest(range(len(own))) AS pos, unnest(boxes) AS z FROM laid JOIN best USING (session_id, variation, spread_idx, k)),
    sharp AS (SELECT *, least(ps[photo + 1].pw / greatest(0.1::DOUBLE, z.w * 420.0::DOUBLE / 25.4::DOUBLE), ps[photo + 1].ph / greatest(0.1::DOUBLE, z.h * 210.0::DOUBLE / 25.4::DOUBLE)) AS dpi FROM spots),
    slots AS (SELECT session_id, chapter, CAST(variation AS INTEGER) AS variation, spread_idx, caption, true AS has_text, CASE sd WHEN 0 THEN 'left' ELSE 'right' END AS side, CAST(pos AS INTEGER) AS pos, ps[photo + 1].id AS photo_id,
      round(z.x, 9) AS x, round(z.y, 9) AS y, round(z.w, 9) AS w, round(z.h, 9) AS h, round(dpi, 6) AS dpi, CASE WHEN dpi >= 250 THEN 'excellent' WHEN dpi >= 150 THEN 'warning' ELSE 'alert' END AS badge, spread_idx * 2 + sd AS page_number FROM sharp)"""


def _rounded(slots):
    """As both engines must show them."""
    return slots.withColumns({**{c: F.round(c, 9) for c in "xywh"}, "dpi": F.round("dpi", 6)})


@query(f"{slots_sql(0)} SELECT * EXCLUDE (variation) FROM slots")
def q_spread(spark, d):
    """Every slot of the first variation's spreads, with page numbers and print quality."""
    s = op.spread_pages(book_spreads(spark, d, 0), "BALANCED")
    return _rounded(s.withColumn("page_number", F.col("spread_idx") * 2 + F.when(F.col("side") == "left", 0).otherwise(1)).drop("variation"))


@query(f"{slots_sql(0, 1, 2)} SELECT * EXCLUDE (page_number) FROM slots")
def q_variation_slots(spark, d):
    """The slots of three books of each session."""
    family = F.element_at(F.array(*map(F.lit, op.FAMILIES)), F.col("variation"))
    return _rounded(op.spread_pages(book_spreads(spark, d, 0, 1, 2), family))


def _books(spark, d):
    """The documents of three books of each session: their pacing and layout family differ."""
    family = F.element_at(F.array(*map(F.lit, op.FAMILIES)), F.col("variation"))
    return bk.documents(op.spread_pages(book_spreads(spark, d, 0, 1, 2), family))


_SIDE = "coalesce(string_agg(concat_ws(':', photo_id, CAST(round(x * 1000000) AS BIGINT), CAST(round(y * 1000000) AS BIGINT), CAST(round(w * 1000000) AS BIGINT), CAST(round(h * 1000000) AS BIGINT), badge), ',' ORDER BY pos) FILTER (WHERE side = '{side}'), '')"


@query(f"{slots_sql(0, 1, 2)} SELECT session_id, chapter, spread_idx, caption, variation, {_SIDE.format(side='left')} AS left_page, {_SIDE.format(side='right')} AS right_page FROM slots GROUP BY ALL")
def q_variations(spark, d):
    """The spreads of three books of each session, written as documents and read back; places in millionths."""
    pages = [bk.page_text(side).alias(f"{side}_page") for side in ("left", "right")]
    return bk.spreads(_books(spark, d)).select("session_id", "chapter", "spread_idx", "caption", "variation", *pages)


_PLACED = f"{slots_sql(0, 1, 2)}, shown AS (SELECT session_id, variation, photo_id, min(struct_pack(s := spread_idx, d := side, p := pos)) AS f FROM slots GROUP BY ALL)"


@query(f"{_PLACED} SELECT session_id, variation, photo_id, row_number() OVER (PARTITION BY session_id, variation ORDER BY f) - 1 AS pos FROM shown")
def q_book_placed(spark, d):
    """The photos of each book by first appearance."""
    return bk.placed_ids(_books(spark, d))


@query(f"{_PLACED} SELECT session_id, variation, count(*) AS total, count(*) FILTER (WHERE NOT synced) AS pending, CASE WHEN count(*) FILTER (WHERE NOT synced) > 0 THEN 409 ELSE 200 END AS code FROM shown JOIN photos USING (session_id, photo_id) GROUP BY session_id, variation")
def q_book_gate(spark, d):
    """Whether each book may be printed: all originals of its photos must have come."""
    return bk.export_gate(_books(spark, d), photos(spark, d))


@query(f"{slots_sql(0, seed=7).replace('CASE variation WHEN 1 THEN false WHEN 2 THEN true', 'CASE WHEN variation > 0 THEN true').replace('CASE variation WHEN 3', 'CASE WHEN variation = 0')} SELECT * EXCLUDE (variation, page_number) FROM slots WHERE spread_idx = 5")
def q_reshuffle(spark, d):
    """One spread of each session laid out anew by another family; photos keep their own pixels."""
    s = book_spreads(spark, d, 0).where("spread_idx = 5")
    return _rounded(op.spread_pages(s, op.FAMILIES[7 % 3], seed=7).drop("variation"))


@query(f"SELECT grp AS session_id, style, rank, photo_id FROM ({st_plan.covers_sql('session_id')})")
def q_book_covers(spark, d):
    p = quality.with_hero(photos(spark, d))
    return st.select_covers(p, "session_id")


