"""Faceted search, presets and paging (Q*)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules


@dataclass(frozen=True)
class SearchParams:
    """Checked search parameters; ranges are (low, high)."""

    q: str | None = None
    brands: tuple = ()
    surface: tuple = ()
    use: tuple = ()
    cushioning: tuple = ()
    width: tuple = ()
    breathability: tuple = ()
    plate: str = "any"            # any | with | without
    waterproof: str = "any"       # any | yes | no
    price: tuple = rules.SEARCH_DEFAULTS["price"]
    weight: tuple = rules.SEARCH_DEFAULTS["weight"]
    drop: tuple = rules.SEARCH_DEFAULTS["drop"]
    date: tuple = (None, None)
    sort: str = "price_asc"
    page: int = 1
    page_size: int = 50

    def __post_init__(self):
        if self.plate not in ("any", "with", "without"):
            raise ValueError(f"plate: {self.plate}")
        if self.waterproof not in ("any", "yes", "no"):
            raise ValueError(f"waterproof: {self.waterproof}")
        field, _, way = self.sort.rpartition("_")
        if field not in ("price", "weight", "drop") or way not in ("asc", "desc"):
            raise ValueError(f"sort: {self.sort}")
        if not 1 <= self.page_size <= 200 or self.page < 1:
            raise ValueError("page >= 1 and 1 <= page_size <= 200")
        for name, low, high in (("price", 50, 1000), ("weight", 100, 500), ("drop", 0, 20)):
            a, b = getattr(self, name)
            if a < low or b > high:
                raise ValueError(f"{name}: within {low}..{high}")

    @classmethod
    def preset(cls, name: str, **more) -> SearchParams:
        lists = {k: tuple(v) if isinstance(v, list) else v
                 for k, v in rules.SEARCH_PRESETS[name].items()}
        return replace(cls(**lists), **more)


_FACETS = {"surface": "surface_type", "use": "primary_use", "cushioning": "cushioning_type",
           "width": "foot_width", "breathability": "upper_breathability"}


def matching(df: DataFrame, p: SearchParams, strict_ranges: bool = False) -> DataFrame:
    """Rows that meet the parameters.

    Plain comparisons come first and reach the file scan.  A range filters only
    when it differs from its default and then drops nulls; `strict_ranges`
    always applies it and reads flags two-valued.
    """
    for name, column in _FACETS.items():
        if getattr(p, name):
            df = df.filter(F.col(column).isin(list(getattr(p, name))))
    for name, yes, column in (("plate", "with", "carbon_plate"),
                              ("waterproof", "yes", "waterproof")):
        want = getattr(p, name)
        if want != "any":
            c = F.coalesce(F.col(column), F.lit(False)) if strict_ranges else F.col(column)
            df = df.filter(c == F.lit(want == yes))
    for name, default in rules.SEARCH_DEFAULTS.items():
        low, high = getattr(p, name)
        if strict_ranges or (low, high) != tuple(default):
            df = df.filter(F.col(name).between(low, high))
    if p.date[0]:
        df = df.filter(F.col("date") >= p.date[0])
    if p.date[1]:
        df = df.filter(F.col("date") <= p.date[1])
    if p.brands:
        df = df.filter(F.lower("brand_name").isin([b.lower() for b in p.brands])
                       if not strict_ranges else F.col("brand_name").isin(list(p.brands)))
    if p.q:
        q = F.lit(p.q.lower())
        if strict_ranges:
            df = df.filter(F.contains(F.lower(F.concat_ws(" ", "brand_name", "model")), q))
        else:
            df = df.filter(F.contains(F.lower("brand_name"), q) | F.contains(F.lower("model"), q))
    return df


def ordering(p: SearchParams, tie: str) -> list[Column]:
    field, _, way = p.sort.rpartition("_")
    c = F.col(field)
    return [c.asc_nulls_first() if way == "asc" else c.desc_nulls_last(), F.col(tie)]


def search(df: DataFrame, p: SearchParams, tie: str = "id",
           strict_ranges: bool = False) -> tuple[DataFrame, DataFrame]:
    """(page, total): both lazy; the page is a top-k, the total one row `total`."""
    hits = matching(df, p, strict_ranges)
    page = hits.orderBy(*ordering(p, tie)).offset((p.page - 1) * p.page_size).limit(p.page_size)
    return page, hits.agg(F.count(F.lit(1)).alias("total"))


def search_latest(df: DataFrame, p: SearchParams, tie: str = "id") -> tuple[DataFrame, DataFrame]:
    """Search over the newest row per brand and model."""
    from specforge.operators.dedup import latest
    return search(latest(df, ["brand_name", "model"], "created_at", tie), p, tie)


def page_with_count(df: DataFrame, order: list[Column], page: int, size: int
                    ) -> tuple[DataFrame, DataFrame]:
    return (df.orderBy(*order).offset((page - 1) * size).limit(size),
            df.agg(F.count(F.lit(1)).alias("total")))


def keyset_page(df: DataFrame, key: str, cursor, size: int,
                unprocessed: Column | None = None) -> DataFrame:
    """The next `size` rows behind the cursor; no offset to skip over."""
    df = df.filter(F.col(key) > cursor)
    if unprocessed is not None:
        df = df.filter(unprocessed)
    return df.orderBy(key).limit(size)


def seek_page(df: DataFrame, order: Sequence[tuple[str, str]], size: int, cursor: dict | None = None) -> DataFrame:
    """The next `size` rows behind a compound cursor; `order` lists (column, "asc" or "desc").

    Nulls come first in ascending and last in descending columns, as in `search`.
    The last column of the order must tell rows apart, or rows that tie with the
    cursor are passed over.  Every task keeps one page, whatever the depth; the
    bound on the first column stands alone, so that it reaches the file scan.
    """
    if cursor is not None:
        df = df.filter(_behind(df, order, cursor))
    return df.orderBy(*[F.col(c).asc_nulls_first() if way == "asc" else F.col(c).desc_nulls_last()
                        for c, way in order]).limit(size)


def _behind(df: DataFrame, order: Sequence[tuple[str, str]], cursor: dict) -> Column:
    """Rows whose sort key comes after the cursor's."""
    def after(name: str, way: str) -> Column:
        c, v = F.col(name), cursor[name]
        if v is None:
            return c.isNotNull() if way == "asc" else F.lit(False)
        v = F.lit(v).cast(df.schema[name].dataType)
        return F.coalesce(c > v, F.lit(False)) if way == "asc" else (c < v) | c.isNull()

    for _, way in order:
        if way not in ("asc", "desc"):
            raise ValueError(f"order: {way}")
    behind = F.lit(False)
    for name, way in reversed(order):
        v = cursor[name]
        same = F.col(name).isNull() if v is None else F.coalesce(
            F.col(name) == F.lit(v).cast(df.schema[name].dataType), F.lit(False))
        behind = after(name, way) | (same & behind)
    name, way = order[0]
    if cursor[name] is None:
        return behind if way == "asc" else F.col(name).isNull() & behind
    v = F.lit(cursor[name]).cast(df.schema[name].dataType)
    return (F.col(name) >= v if way == "asc" else (F.col(name) <= v) | F.col(name).isNull()) & behind


def next_cursor(page: DataFrame, order: Sequence[tuple[str, str]]) -> dict | None:
    """Sort values of a page's last row; null where the page is empty.  One row reaches the driver."""
    turned = [F.col(c).desc_nulls_last() if way == "asc" else F.col(c).asc_nulls_first() for c, way in order]
    row = page.select(*[c for c, _ in order]).orderBy(*turned).first()
    return None if row is None else row.asDict()


def seek_order(p: SearchParams, tie: str) -> list[tuple[str, str]]:
    """The order of a search as `seek_page` takes it."""
    field, _, way = p.sort.rpartition("_")
    return [(field, way), (tie, "asc")]


def search_seek(df: DataFrame, p: SearchParams, cursor: dict | None = None, tie: str = "id",
                strict_ranges: bool = False) -> DataFrame:
    """The page of a search behind a cursor; `p.page` is not used."""
    return seek_page(matching(df, p, strict_ranges), seek_order(p, tie), p.page_size, cursor)


def newest(df: DataFrame, created: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.col(created).desc(), F.col(tie).desc()).limit(k)


def csv_page(page: DataFrame) -> DataFrame:
    """Search page as export columns: nulls empty, flags yes or no."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    yn = lambda c: F.when(F.col(c), "yes").otherwise("no")
    source = ["brand_name", "model", "primary_use", "surface_type", "heel_height",
              "forefoot_height", "drop", "weight", "price", "carbon_plate", "waterproof",
              "cushioning_type", "foot_width", "upper_breathability", "date", "source_link"]
    return page.select(*[(yn(c) if c in rules.BOOLEAN_FIELDS else s(c)).alias(n)
                         for c, n in zip(source, rules.PAGE_COLUMNS, strict=True)])


def quoted_csv(df: DataFrame) -> Column:
    """One line: every cell quoted, quotes doubled."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(
        F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[cell(c) for c in df.columns])


