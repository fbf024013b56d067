"""Small dimensions as literal tables.

Fixed values: theme palettes, category tables, template list, captions. They name what
results must name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# theme: background, surface, primary, accent, text
PALETTES = {
    "Warm": ("#FFF9F2", "#F5E7D6", "#D5B18A", "#A87552", "#604638"),
    "Elegant": ("#FFFFFF", "#F5F0E7", "#D4C1A0", "#A88B5A", "#4A443D"),
    "Romantic": ("#FFF8F8", "#F7E3E7", "#E0AEB8", "#B76B7A", "#70434D"),
    "Minimal": ("#FFFFFF", "#F5F5F2", "#D9D8D3", "#A4A39E", "#444340"),
    "Classic": ("#FFFFFF", "#F2EFE9", "#C8C1B5", "#80796F", "#383531"),
    "Vintage": ("#F7F0E4", "#E9DDC8", "#C3A47D", "#92704F", "#5D493B"),
    "Nostalgic": ("#FAF3E9", "#EFE1D0", "#C9A487", "#9B6F59", "#60483E"),
    "Coastal": ("#FAFEFE", "#E8F5F5", "#9ACED0", "#4E9BA5", "#286174"),
    "Tropical": ("#FFF8E7", "#EEF2D9", "#B5CC8A", "#5C9860", "#E39A58"),
    "Adventure": ("#F8F2E8", "#E8DDCB", "#B89062", "#6C593F", "#385044"),
    "Nature": ("#F8F7EF", "#E6E9DE", "#A9B78E", "#5C7655", "#304B3A"),
    "Sunset": ("#FFF5E9", "#FFE4C5", "#F4A26C", "#D86B50", "#824C4A"),
    "Festive": ("#FFFDF5", "#FFF1D2", "#D94D48", "#C58A2B", "#28745B"),
    "Playful": ("#FFFDF8", "#FFE4D8", "#FFB19D", "#78C5C3", "#8B7BB5"),
    "Luxury": ("#FFFFFF", "#F2EEE4", "#C7A765", "#756346", "#242424"),
    "Editorial": ("#FFFFFF", "#F3F0EB", "#C5BDB4", "#81786F", "#292827"),
    "Urban": ("#F8F8F6", "#E7E7E4", "#B7B7B2", "#6A6A66", "#292929"),
    "Night": ("#171724", "#36365B", "#684A92", "#D45A96", "#F5EDFF"),
    "Achievement": ("#FFFFFF", "#F2F0E8", "#C5A75C", "#536879", "#292D32"),
    "Monochrome": ("#FFFFFF", "#D8D8D8", "#929292", "#454545", "#111111"),
}
# category: themes in order of preference
THEMES = {
    "Family": ("Warm", "Classic", "Nostalgic"),
    "Travel": ("Coastal", "Tropical", "Adventure", "Nature", "Sunset"),
    "Celebration": ("Elegant", "Romantic", "Festive", "Playful", "Luxury"),
    "Everyday": ("Warm", "Minimal", "Urban"),
    "Portraits": ("Classic", "Minimal", "Editorial", "Monochrome"),
    "Nature": ("Nature", "Coastal", "Sunset"),
    "Lifestyle": ("Warm", "Editorial", "Urban", "Luxury"),
    "Milestones": ("Achievement", "Elegant", "Classic"),
    "Activities": ("Adventure", "Playful", "Night", "Urban"),
    "Memories": ("Nostalgic", "Vintage", "Monochrome", "Warm"),
}
# category: heading font, body font
FONTS = {
    "Wedding": ("Playfair Display", "Cormorant Garamond"),
    "Travel": ("Montserrat", "Lato"),
    "Celebration": ("Poppins", "Quicksand"),
    "Baby": ("Fredoka", "Nunito"),
    "Family": ("Merriweather", "Open Sans"),
    "Milestones": ("Cinzel", "Roboto"),
    "Memories": ("Lora", "Raleway"),
    "Portraits": ("Inter", "Space Grotesk"),
    "Minimal": ("Helvetica", "Inter"),
    "Vintage": ("Special Elite", "Old Standard TT"),
}
# template: photo count
TEMPLATES = {
    "tpl_1p_hero_right_journal": 1,
    "tpl_1p_hero_left_clean": 1,
    "tpl_2p_split_facing_balanced": 2,
    "tpl_2p_left_stacked_duo": 2,
    "tpl_3p_hero_left_stacked_right": 3,
    "tpl_3p_stacked_left_hero_right": 3,
    "tpl_4p_2x2_split_grid": 4,
}
CAPTIONS = (
    ("THE JOURNEY BEGINS AT FIRST LIGHT", "BLUE SKIES OVER SACRED SPIRES", "TOGETHER IN THE SOFT AFTERNOON", "MOMENTS TO TREASURE FOREVER"),
    ("FIRST LIGHT REFLECTIONS", "ARCHITECTURAL MAJESTY", "SHARED LAUGHTER & BLISS", "UNFORGETTABLE FOOTPRINTS"),
    ("STEPPING INTO PEACE", "FAITH, FELLOWSHIP & SMILES", "GOLDEN HOUR TOGETHERNESS", "MEMORIES WRITTEN IN SUNLIGHT"),
)


def palettes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, *c) for t, c in PALETTES.items()], "theme string, background string, surface string, primary string, accent string, text string")


def themes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, list(t)) for c, t in THEMES.items()], "category string, themes array<string>")


def fonts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *f) for c, f in FONTS.items()], "category string, heading string, body string")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, n, k) for k, (t, n) in enumerate(TEMPLATES.items())], "template string, photo_count int, seq int")


def values(rows: list[tuple], names: str) -> str:
    """DuckDB: a literal table."""
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + f") t({names})"
