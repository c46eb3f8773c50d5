"""Made-up product titles, for trying out tokenizers and searches at any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of each category its share in 500 titles, makers, things (with a weight each) and details. Titles mix cases, hyphens, slashes, units on numbers and parentheses.
CATEGORIES = {
    "Electronics": (100, ["Nordlys", "Kestrel", "OmniTek", "Veld"], {"Phone 5G": 28, "Laptop 14-inch": 20, "Earbuds": 18, "Charger": 10, "Power Bank": 8, "USB-C Cable": 8, "Smartwatch": 8}, ["(8GB RAM/128GB)", "65W", "10000mAh", "with ANC | Black", "1.5m"]),
    "Fashion": (80, ["Marrow & Pine", "Halden", "Juniper's"], {"Shirt": 16, "Dress": 14, "T-Shirt": 14, "Jeans": 12, "Sneakers": 14, "Scarf Set": 10}, ["(Blue, XL)", "Cotton-Blend", "Slim/Regular Fit", "Pack of 2"]),
    "Home & Kitchen": (80, ["Castor", "Ironleaf", "Brasa"], {"Frying Pan": 20, "Bottle": 16, "Container Set": 14, "Pressure Cooker": 16, "Mixer": 14}, ["24cm", "1L (Steel)", "750W", "Non-Stick | 3 Pcs", "5L/Induction"]),
    "Sports & Fitness": (60, ["Rove", "Trailhead", "Kinetik"], {"Running Shoes": 16, "Dumbbell": 16, "Yoga Mat": 10, "Whey Protein": 10, "Vitamin Tablets": 8}, ["(UK 9)", "5kg", "6mm Anti-Slip", "1kg - Cocoa", "60 Count"]),
    "Books & Education": (50, ["Larkspur Press", "Quill/Co", "N. Ostrander"], {"Exam Guide": 18, "Novel": 16, "Textbook": 16}, ["2024 Edition", "(Paperback)", "Vol. 2", "Class 10th"]),
    "Beauty & Personal Care": (50, ["Sorrel", "D'Amare", "Pure-Ly"], {"Face Cream": 12, "Shampoo": 12, "Perfume": 14, "Sunscreen": 12}, ["50g", "340ml", "SPF50 PA+++", "(Unisex) 100ml"]),
    "Grocery & Household": (40, ["Harvest Mill", "Goodacre's"], {"Olive Oil": 14, "Pepper Powder": 14, "Floor Cleaner": 12}, ["1L Pouch", "200g", "2x500ml", "(Refill)"]),
    "Baby & Kids": (40, ["Tumble", "Little Fern"], {"Building Blocks": 12, "Diapers": 10, "Cereal": 8, "Crayons": 10}, ["(3+ Years)", "72 Count | M", "Stage 2 - 300g", "24 Shades"]),
}


def chance(seed: int, *salt: Column | int) -> Column:
    """A number from 0 to below 1 that follows from the row, the seed and a salt alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *(s if isinstance(s, Column) else F.lit(s) for s in salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def weighted(choices: dict[str, int], at: Column) -> Column:
    """One of the choices, each as often as its weight says, by a number from 0 to below 1."""
    total, below, column = sum(choices.values()), 0, None
    for name, weight in choices.items():
        below += weight
        hit = at < below / total
        column = F.when(hit, F.lit(name)) if column is None else column.when(hit, F.lit(name))
    return column.otherwise(F.lit(name))


def title_of(category: str, seed: int, row: Column) -> Column:
    """A title of a category: a maker, a thing by weight, and a detail."""
    _, makers, things, details = CATEGORIES[category]
    return F.concat_ws(" ", weighted(dict.fromkeys(makers, 1), chance(seed, 1, row)), weighted(things, chance(seed, 2, row)), weighted(dict.fromkeys(details, 1), chance(seed, 3, row)))


def make_titles(spark: SparkSession, rows: int = 500, seed: int = 42) -> DataFrame:
    """product_id (fk-001 and so on), title and category of so many rows, categories mixed and exactly in their shares (in blocks of 500 rows); the same for the same seed, however many tasks make them."""
    total = sum(share for share, *_ in CATEGORIES.values())
    n = F.col("id")
    # A step without a common factor visits each place of a block once, so shares are exact and mixed.
    place = F.pmod(n * 183 + seed, F.lit(total)) / F.lit(float(total))
    category = weighted({name: share for name, (share, *_) in CATEGORIES.items()}, place)
    made = spark.range(rows).select(n, category.alias("category"))
    title = reduce(lambda column, name: column.when(F.col("category") == name, title_of(name, seed, n)), list(CATEGORIES)[1:], F.when(F.col("category") == next(iter(CATEGORIES)), title_of(next(iter(CATEGORIES)), seed, n)))
    return made.select(F.format_string("fk-%03d", n + 1).alias("product_id"), title.alias("title"), "category")
