"""Tables of the registered queries: the given ones and two derived from them.

`articles` (from documents) wraps every whole text with headed spec blocks,
`products` (from orders) has one product row per order.  Both are row-local
projections written in expressions that mean the same in Spark SQL and DuckDB,
so the checks read the same rows and grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _one_of(names: str, index: str) -> str:
    n = names.count(",") + 1
    return f"split_part('{names}', ',', cast(({index}) % {n} as int) + 1)"


def _str(expr: str) -> str:
    return f"cast({expr} as string)"


_BRANDS = "Nike,Hoka,Brooks,Asics,Saucony,On,Altra,Mizuno"
_SERIES = "Pegasus,Ghost,Clifton,Speedgoat,Nimbus,Kinvara,Triumph,Torin,Vomero,Mach"


def _name(k: int) -> str:
    return (f"{_one_of(_BRANDS, f'doc_id + {k}')} || ' ' || "
            f"{_one_of(_SERIES, f'doc_id * 3 + {k}')} || ' ' || {_str(f'(doc_id + {k * 5}) % 40 + 1')}")


def _sentence(k: int) -> str:
    w = _str(f"200 + (doc_id * 11 + {k * 17}) % 150")
    d = _str(f"(doc_id + {k}) % 13")
    h = _str(f"30 + (doc_id * 5 + {k}) % 12")
    f = _str(f"20 + (doc_id * 7 + {k}) % 9")
    p = _str(f"55 + (doc_id * 3 + {k * 7}) % 300")
    return f"""CASE (doc_id + {k}) % 6
 WHEN 0 THEN 'Weighing 10.2 ounces (' || {w} || ' grams) with a ' || {d} || '.5-millimeter drop and ' || {h} || '-millimeter stack height at the heel. Good for road-to-trail.'
 WHEN 1 THEN 'At 8.9 oz the drop is ' || {d} || ' mm. Stack ' || {h} || '-' || {f} || ' millimeters, waterproof upper, daily training.'
 WHEN 2 THEN 'Weight: ' || {w} || ' g, drop: ' || {d} || ' mm. Heel ' || {h} || ' mm, forefoot ' || {f} || ' mm. A carbon plate for racing.'
 WHEN 3 THEN 'Gewicht: ' || {w} || 'g, Sprengung: ' || {d} || ' mm, ' || {f} || ' mm Vorfuß / ' || {h} || ' mm Ferse. Not waterproof, recovery runs.'
 WHEN 4 THEN {h} || ' mm in heel, ' || {f} || ' mm in forefoot, costs $' || {p} || '. Midsole and outsole grip, neutral stability vs. a plush trainer.'
 ELSE 'A soft ride without numbers. Price: €' || {p} || ' or 180,$' || {p} || '.' END"""


def _block(k: int) -> str:
    up = " — Runner-Up" if k == 1 else ""
    surface = f"CASE (doc_id + {k}) % 3 WHEN 0 THEN 'Road' ELSE 'Trail' END"
    price = _str(f"60 + (doc_id * 7 + {k * 13}) % 200")
    return (f"'Best ' || {surface} || ' Running Shoes{up}: ' || {_name(k)} || ' ($' || {price}"
            f" || ')' || chr(10) || {_sentence(k)} || chr(10) || chr(10)")


ARTICLES = {
    "doc_id": "doc_id",
    "source_id": "source || '-' || " + _str("doc_id"),
    "title": f"""CASE doc_id % 8 WHEN 0 THEN {_name(0)} || ' Review'
 WHEN 1 THEN 'Best Running Shoes 2024' WHEN 2 THEN {_one_of(_BRANDS, 'doc_id')} || ' Running Shoes Overview'
 WHEN 3 THEN 'The best watches and headphones of ' || {_str('doc_id')}
 WHEN 4 THEN 'First look: ' || {_name(0)} || ' - daily trainer'
 WHEN 5 THEN split_part(text, chr(10), 1) WHEN 6 THEN 'Ghost 17 vs Pegasus ' || {_str('doc_id % 50')} || ' comparison'
 ELSE 'Trail Running Tips' END""",
    "content": f"""CASE WHEN doc_id % 5 = 0 THEN text ELSE {_block(0)}
 || CASE WHEN doc_id % 5 > 1 THEN {_block(1)} ELSE '' END
 || CASE WHEN doc_id % 5 > 2 THEN {_block(2)} ELSE '' END || text END""",
    "text": "text",
    "date": "'2024-0' || " + _str("doc_id % 9 + 1") + " || '-1' || " + _str("doc_id % 10"),
    "link": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://www.example.org/' || source || '/' || "
            + _str("doc_id") + " || '/?ref=' || lang END",
    "lang": "lang",
}

_K = "(o_orderkey * 31 + o_custkey)"
_B = _one_of(_BRANDS, "o_orderkey * 7 + o_custkey")


def _dbl(expr: str) -> str:
    return f"cast({expr} as double)"


PRODUCTS = {
    "id": "o_orderkey",
    "source_id": "cast(floor(o_custkey / 10) as bigint)",
    "brand_name": f"CASE WHEN {_K} % 97 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN upper({_B})"
                  f" WHEN o_orderkey % 3 = 1 THEN lower({_B}) ELSE {_B} END",
    "model": f"CASE WHEN {_K} % 89 = 0 THEN '' ELSE {_one_of(_SERIES, 'o_orderkey + o_custkey * 3')}"
             f" || CASE WHEN {_K} % 4 = 0 THEN '' ELSE ' ' || {_str(f'{_K} % 5 + 1')} END"
             f" || CASE WHEN {_K} % 6 = 0 THEN ' Running Shoe' ELSE '' END END",
    "heel_height": f"CASE WHEN {_K} % 7 = 0 THEN NULL WHEN {_K} % 29 = 0 THEN 75.0 ELSE {_dbl(f'24 + {_K} % 19')} END",
    "forefoot_height": f"CASE WHEN {_K} % 5 = 0 THEN NULL ELSE {_dbl(f'18 + {_K} % 11')} + 0.125 END",
    "drop": f"CASE WHEN {_K} % 3 = 0 THEN NULL WHEN {_K} % 31 = 0 THEN 24.0 ELSE {_dbl(f'{_K} % 12')} END",
    "weight": f"CASE WHEN {_K} % 11 = 0 THEN NULL WHEN {_K} % 13 = 0 THEN 9.5 WHEN {_K} % 17 = 0 THEN 900.0"
              f" ELSE {_dbl(f'180 + {_K} % 150')} END",
    "price": f"CASE WHEN {_K} % 9 = 0 THEN NULL ELSE {_dbl(f'30 + {_K} % 500')} END",
    "currency": f"CASE {_K} % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN '£' WHEN 2 THEN 'usd' ELSE NULL END",
    "carbon_plate": f"CASE {_K} % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
    "waterproof": f"CASE {_K} % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
    "upper_breathability": f"CASE {_K} % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE NULL END",
    "primary_use": f"CASE {_K} % 6 WHEN 0 THEN 'daily trainer' WHEN 1 THEN 'racing' WHEN 2 THEN 'trail running'"
                   " WHEN 3 THEN 'Unknown' ELSE NULL END",
    "cushioning_type": f"CASE {_K} % 7 WHEN 0 THEN 'Max' WHEN 1 THEN 'firm' WHEN 2 THEN ' BALANCED ' WHEN 3"
                       " THEN 'squishy' WHEN 4 THEN 'max' ELSE NULL END",
    "surface_type": f"CASE {_K} % 3 WHEN 0 THEN 'road' WHEN 1 THEN 'trail' ELSE NULL END",
    "foot_width": f"CASE {_K} % 8 WHEN 0 THEN 'wide' WHEN 1 THEN 'standard' WHEN 2 THEN 'narrow' ELSE NULL END",
    "additional_features": f"CASE {_K} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n/a'"
                           f" ELSE 'feature ' || {_str(f'{_K} % 100')} END",
    "source_link": "'https://example.org/o/' || " + _str("o_orderkey % 5000"),
    "created_at": "o_orderdate",
    "date": "substring(cast(o_orderdate as string), 1, 10)",
}

DERIVED = {"articles": ("documents", ARTICLES), "products": ("orders", PRODUCTS)}


def articles_of(documents: DataFrame) -> DataFrame:
    """The articles of a frame of documents, also of a stream."""
    return documents.selectExpr(*[f"{e} AS `{c}`" for c, e in ARTICLES.items()])


class Tables:
    """Lazy access by attribute: `t.orders`, `t.articles`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in DERIVED:
            base, cols = DERIVED[name]
            return getattr(self, base).selectExpr(*[f"{e} AS `{c}`" for c, e in cols.items()])
        raise AttributeError(name)


def cte(name: str) -> str:
    """The same derived table as a common table expression for the oracle."""
    base, cols = DERIVED[name]
    body = ", ".join(f'{e} AS "{c}"' for c, e in cols.items())
    return f"{name} AS (SELECT {body} FROM {base})"
