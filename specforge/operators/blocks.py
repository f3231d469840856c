"""Headed texts to product rows: headings, blocks, specs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import keys, text, units
from specforge.functions import regex as rx

# Marks written around matches.  Control characters, removed from the text first.
OPEN, MID, MID2, CLOSE = "\x01", "\x02", "\x03", "\x04"


def _clean(c: Column) -> Column:
    # Few texts hold a mark, and a search for one is many times cheaper than the copy.
    marks = OPEN + MID + MID2 + CLOSE
    held = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks])
    return text.let(c, lambda t: F.when(held(t), F.translate(t, marks, "    ")).otherwise(t))


def _heading_model(c: Column) -> Column:
    return text.trim(rx.sub(text.trim(c), rules.HEADING_PREFIX))


def _real_heading(model: Column) -> Column:
    """Neither a generic word nor lower case nor an unlikely length."""
    return (~rx.test(model, rules.HEADING_GENERIC) & rx.test(model, "[A-Z]", "")
            & F.length(model).between(3, 50))


def headings(content: Column) -> Column:
    """array<struct(start, heading, brand_model, price, block)> of one text.

    One pass marks every heading, a split cuts the text there; a rejected
    heading is folded back into the block before it.  The work stays inside the
    row, so a text of any size needs no shuffle.  `block` is the heading, a line
    end and the trimmed text up to the next heading.
    """
    marked = F.regexp_replace(_clean(content), rx.java(rules.HEADING, "im"),
                              f"{OPEN}$0{MID}$1{MID2}$2{CLOSE}")
    parts = F.split(marked, OPEN)
    model = lambda p: _heading_model(
        F.substring_index(F.substring_index(p, MID2, 1), MID, -1))
    plain = lambda p: F.concat(F.substring_index(p, MID, 1),
                               F.substring_index(p, CLOSE, -1))
    kept = F.transform(parts, lambda p, i: F.when(i == 0, p).when(
        _real_heading(model(p)), F.concat(F.lit(OPEN), p)).otherwise(plain(p)))
    cut = F.split(F.array_join(kept, ""), OPEN)
    rows = F.transform(text.tail(cut), lambda p: F.struct(
        text.trim(F.substring_index(p, MID, 1)).alias("heading"),
        model(p).alias("brand_model"),
        F.nullif(F.substring_index(F.substring_index(p, CLOSE, 1), MID2, -1), F.lit("")
                 ).try_cast("double").alias("price"),
        F.concat(text.trim(F.substring_index(p, MID, 1)), F.lit("\n"),
                 text.trim(F.substring_index(p, CLOSE, -1))).alias("block")))
    return rows


def explode_blocks(df: DataFrame, content: str, keep: list[str], outer: bool = False) -> DataFrame:
    """One row per block: keep columns, block_no (1-based), heading, brand_model, price, block.

    The generator takes the expression itself: on a column the optimizer would
    infer a filter and compute the array again for it.  With `outer` a text without
    blocks gives a row of nulls.
    """
    rows = F.posexplode_outer if outer else F.posexplode
    return (df.select(*keep, rows(headings(F.col(content))).alias("_i", "_h"))
            .select(*keep, (F.col("_i") + 1).alias("block_no"), "_h.*")
            .withColumnRenamed("price", "heading_price"))


def split_brand_model(c: Column) -> Column:
    """struct(brand_name, model): known brand prefix, else the first word."""
    t = text.trim(c)
    out = None
    for b in rules.BLOCK_BRANDS:
        hit = F.struct(F.lit(b).alias("brand_name"), F.nullif(
            text.trim(F.substring(t, len(b) + 1, F.length(t))), F.lit("")).alias("model"))
        test = F.startswith(F.lower(t), F.lit(b.lower()))
        out = (F if out is None else out).when(test, hit)
    first = rx.pick(t, r"^(\S+)", 1, "")
    rest = rx.pick(t, r"^\S+\s+(.+)$", 1, "")
    return out.otherwise(F.struct(
        first.alias("brand_name"),
        F.when(rest.isNotNull(), keys.refine_model(first, rest)).alias("model")))


def _low(block: Column) -> Column:
    return F.lower(block)


def price_of(block: Column) -> Column:
    """First bracketed or dollar amount, only when it is a plausible price."""
    hit = rx.pick(block, "|".join(rules.PRICE_IN_BLOCK), 0, "")
    n = F.regexp_extract(hit, r"(\d{2,4})", 1).try_cast("double")
    return text.let(n, lambda x: units.keep_in_bounds(x, "price"))


def weight_of(block: Column, patterns=rules.WEIGHT_PATTERNS, low: Column | None = None) -> Column:
    """Grams, first matching pattern; ounces converted."""
    out, low = [], _low(block) if low is None else low
    for pattern, group, unit in patterns:
        n = rx.pick_num_low(low, block, pattern, group)
        out.append(n if unit == "g" else units.oz_to_grams(n, rules.OZ_TO_GRAMS_TEXT))
    return F.coalesce(*out)


def heights_of(block: Column, pairs=rules.PAIR_PATTERNS, low: Column | None = None) -> Column:
    """struct(heel_height, forefoot_height): pair patterns first, then single mentions."""
    low = _low(block) if low is None else low
    num = lambda p, g=1: rx.pick_num(block, p, g)

    def both(h, f):
        return F.struct(h.alias("heel_height"), f.alias("forefoot_height"))
    out = None
    for pattern, heel, fore in pairs:
        hit = both(num(pattern, heel), num(pattern, fore))
        test = F.coalesce(rx.guard(low, pattern, rx.test(block, pattern)), F.lit(False))
        out = (F if out is None else out).when(test, hit)
    nz = lambda x: F.when(x != 0, x)

    def single(v):
        heel = F.coalesce(v["pair_h"], nz(v["at_heel"]), F.when(v["general"] > 15, v["general"]), v["at_heel"])
        fore = F.coalesce(v["pair_f"], v["fore"])
        return both(F.coalesce(nz(heel), F.when(nz(fore).isNull() & (v["stack"] > 15), v["stack"]), heel), fore)
    # Bound once: the choice names each mention several times.  A mention is looked for where its word stands.
    near = lambda c, *words: F.when(reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words]), c)
    mentions = F.struct(near(num(rules.HEEL_GENERAL), "heel", "stack").alias("general"),
                        near(num(rules.HEEL_AT_HEEL), "heel").alias("at_heel"),
                        near(num(rules.FOREFOOT_GENERAL), "forefoot").alias("fore"),
                        near(num(rules.BOTH_HEIGHTS, 1), "forefoot").alias("pair_h"),
                        near(num(rules.BOTH_HEIGHTS, 2), "forefoot").alias("pair_f"),
                        near(num(rules.STACK_GENERAL), "stack", "height").alias("stack"))
    # no alternative can match without a unit word: skip the scans
    return out.when(F.contains(low, F.lit("millimeter")), text.let(mentions, single)
                    ).otherwise(both(F.lit(None).cast("double"), F.lit(None).cast("double")))


def drop_of(block: Column, patterns=rules.DROP_PATTERNS, low: Column | None = None) -> Column:
    low = _low(block) if low is None else low
    explicit = [rx.pick_num_low(low, block, p) for p in patterns]
    return F.coalesce(*explicit, F.when(F.contains(low, F.lit("drop")) & rx.test(
        block, rules.ZERO_DROP), F.lit(0.0)))


def use_and_surface(heading: Column, block: Column) -> Column:
    """struct(primary_use, surface_type); mixed surfaces count as road."""
    return text.let(F.lower(F.concat_ws(" ", heading, block)), _use_and_surface)


def _use_and_surface(low: Column) -> Column:
    any_word = lambda ws: rx.any_low(low, ws.split("|"))
    trail, road = any_word("trail"), any_word("road|pavement|asphalt|versatile")
    surface = F.when(trail, "trail").when(road, "road")
    use = None
    for pattern, name in rules.USE_SPECIFIC:
        use = (F if use is None else use).when(any_word(pattern), name)
    return F.struct(
        use.when(trail, "trail running").when(road, "road").alias("primary_use"),
        surface.alias("surface_type"))


def waterproof_of(block: Column, low: Column | None = None) -> Column:
    low = _low(block) if low is None else low
    # Only the start of the first mention matters: 'not ' or the word itself.  Words
    # that need another one behind them are looked for in front of its last place.
    starts = [F.when(F.contains(low, F.lit(guard)), F.nullif(F.regexp_instr(
        low if behind is None else F.regexp_extract(low, rx.java(rf"^([\s\S]*){behind}\b", ""), 1),
        F.lit(rx.java(rf"\b(?:not\s+)?{word}", ""))), F.lit(0)))
        for guard, word, behind in rules.WATERPROOF_WORDS]
    negated = lambda first: F.substring(low, first, F.lit(4)).rlike(f"^not[{rx.BLANK}]")
    negation = F.exists(F.split(low, r"\."), lambda s: rx.test(F.substring(
        s, F.nullif(F.regexp_instr(s, F.lit(rx.java(rules.NEGATION_START, ""))), F.lit(0)), F.length(s)),
        rules.WATERPROOF_END, ""))
    # Bound once: a first mention is tested and then read.
    return text.let(F.least(*starts), lambda first: F.when(first.isNotNull(), ~negated(first))
                    .when(F.contains(low, F.lit("water")) & F.coalesce(negation, F.lit(False)), F.lit(False)))


def carbon_of(block: Column, low: Column | None = None) -> Column:
    low = _low(block) if low is None else low
    behind = F.substring(low, F.instr(low, "carbon") + 6, F.length(low))
    return F.when(F.contains(low, F.lit("carbon")) & text.contains_any(behind, rules.CARBON_PARTS), F.lit(True))


def extract_specs(blocks: DataFrame, profile: str = "full") -> DataFrame:
    """Typed values of each block, in the reduced form of the text path.

    Input: heading, brand_model, heading_price, block.  A false flag becomes
    null (only a positive statement counts here), a zero drop survives.
    `profile='classic'` uses the older rule set.
    """
    full = profile == "full"
    b, low = F.col("block"), F.col("_low")
    blocks = blocks.withColumn("_low", F.lower(b))
    bm = split_brand_model(F.col("brand_model"))
    read = F.struct(
        bm.alias("bm"), use_and_surface(F.col("heading"), b).alias("use"),
        heights_of(b, rules.PAIR_PATTERNS if full else rules.CLASSIC_PAIR_PATTERNS, low).alias("h"),
        drop_of(b, rules.DROP_PATTERNS if full else rules.CLASSIC_DROP_PATTERNS, low).alias("drop"),
        weight_of(b, rules.WEIGHT_PATTERNS if full else rules.CLASSIC_WEIGHT_PATTERNS, low).alias("w"),
        F.coalesce(F.when(F.col("heading_price") != 0, F.col("heading_price")), price_of(b)).alias("p"),
        waterproof_of(b, low).alias("wp"), carbon_of(b, low).alias("cp"))
    # Behind a generator, since a filter on the values would read the block again for each.
    df = blocks.select("*", F.explode(F.array(read)).alias("_v")).withColumns({
        f"_{f}": F.col(f"_v.{f}") for f in ("bm", "use", "h", "drop", "w", "p", "wp", "cp")})
    heel, fore = F.col("_h.heel_height"), F.col("_h.forefoot_height")
    derived = F.when((heel != 0) & (fore != 0), text.round_to(heel - fore, 1))
    nz = lambda c: F.when(c != 0, c)
    none = F.lit(None).cast("string")
    return df.withColumns({
        "brand_name": F.col("_bm.brand_name"), "model": F.col("_bm.model"),
        "heel_height": nz(heel), "forefoot_height": nz(fore),
        "drop": F.coalesce(F.col("_drop"), derived),
        "weight": text.js_round(nz(F.col("_w"))),
        "price": units.keep_in_bounds(F.col("_p"), "price"),
        "upper_breathability": none,
        "carbon_plate": F.when(F.col("_cp"), True),
        "waterproof": F.when(F.col("_wp"), True),
        "primary_use": F.col("_use.primary_use"),
        "cushioning_type": none,
        "surface_type": F.col("_use.surface_type"),
        "foot_width": none, "additional_features": none,
    }).drop("_low", "_v", "_bm", "_use", "_h", "_drop", "_w", "_p", "_wp", "_cp")


def quality_name(brand: Column, model: Column) -> Column:
    """Known brand and a model with digits or of a known series."""
    return brand.isin(rules.MENTION_BRANDS) & (
        rx.test(model, r"\d") | rx.test(model, rules.QUALITY_SERIES))


# --- mentions in running text ------------------------------------------------

def _joined(parts: Column, start, size) -> Column:
    return F.replace(F.array_join(F.slice(parts, start, size), ""), F.lit(MID), F.lit(""))


def match_contexts(content: Column, pattern: str, before: int, after: int,
                   flags: str = "i", min_match: int = 2) -> Column:
    """array<struct(match, before, after)> with bounded text around each match."""
    def mark(clean):
        lit = rx.required(pattern)
        marked = F.regexp_replace(clean, rx.java(pattern, flags), f"{OPEN}$0{MID}")
        low = F.lower(clean) if lit.upper() != lit else clean
        return F.when(F.contains(low, F.lit(lit)), marked).otherwise(clean) if lit else marked
    marked = text.let(_clean(content), mark)
    return marked_contexts(marked, before, after, min_match)


def mark_heights(content: Column, word: str) -> Column:
    """The text with its height mentions marked: one a line, from the first two-digit
    millimetres or `word` to the last of the other.

    This is what the rule pattern finds, but by single scans per line: the pattern
    would run from each word to the line end.  A line end between a number and its
    unit ends the line.
    """
    mm = r"\d{2}\s*mm"

    def mark(line):
        def cut(at, rest):
            to = lambda p: F.regexp_extract(rest, f"(?is)^(.*{rx.java(p, '')})", 1)
            body = F.when(at["number"] < at["named"], to(word)).otherwise(to(mm))
            return text.let(body, lambda b: F.concat(
                F.substring(line, F.lit(1), F.least(at["number"], at["named"]) - 1), F.lit(OPEN), b, F.lit(MID),
                F.substring(rest, F.length(b) + 1, F.length(line))))
        places = F.struct(F.regexp_instr(line, F.lit(rx.java(mm))).alias("number"),
                          F.regexp_instr(line, F.lit(rx.java(word))).alias("named"))
        return text.let(places, lambda at: text.let(
            F.substring(line, F.least(at["number"], at["named"]), F.length(line)), lambda rest: cut(at, rest)))

    def by_line(clean):
        lines = F.split(clean, r"(?<=[\n\r\x{2028}\x{2029}])")
        marked = F.array_join(F.transform(lines, lambda x: F.when(
            F.contains(F.lower(x), F.lit(word)) & rx.test(x, mm), mark(x)).otherwise(x)), "")
        return F.when(F.contains(F.lower(clean), F.lit(word)), marked).otherwise(clean)
    return text.let(_clean(content), by_line)


def marked_matches(marked: Column) -> Column:
    return F.transform(text.tail(F.split(marked, OPEN)), lambda p: F.substring_index(p, MID, 1))


def marked_contexts(marked: Column, before: int, after: int, min_match: int = 2) -> Column:
    """Contexts of a marked text.

    The text is split once at the marks.  A context reaches back over at most
    `before / min_match` parts, so the work is linear in the text; mostly the nearest
    parts are long enough and only they are joined.
    """
    kb, ka = before // min_match + 2, after // min_match + 2
    near = 3

    def reach(join, size, most):
        return F.when(F.lit(most <= near), join(most)).otherwise(text.let(join(near), lambda x: F.when(
            F.length(x) >= size, x).otherwise(join(most))))

    def one(parts, p, i):  # i is the zero-based index of the match, part i + 1 holds it
        def back(k):
            lo = F.greatest(F.lit(1), i + 2 - k)
            return _joined(parts, lo, i + 2 - lo)

        def ahead(k):
            return F.concat(F.substring_index(p, MID, -1), _joined(parts, i + 3, F.lit(k)))
        return F.struct(F.substring_index(p, MID, 1).alias("match"),
                        F.right(reach(back, before, kb), F.lit(before)).alias("before"),
                        F.substring(reach(ahead, after, ka), 1, after).alias("after"))
    return text.let(F.split(marked, OPEN), lambda parts: F.transform(
        text.tail(parts), lambda p, i: one(parts, p, i)))


def valid_model_part(model: Column) -> Column:
    return (F.length(model).between(2, 25)
            & (rx.test(model, r"\d") | rx.test(model, rules.PART_SERIES))
            & ~rx.test(model, rules.PART_INVALID_WORD)
            & ~rx.test(model, rules.PART_INVALID_PHRASE))


def mentions(content: Column) -> Column:
    """array<struct(heading, brand_model, price, block)> of unheaded texts.

    Brand + name + number or brand + known series, in text order; a mention owns
    the text up to the next one, the last the rest of the text.
    """
    brands = "|".join(rf"{rx.literal(b)}\b" if len(b) <= 2 else rx.literal(b)
                      for b in rules.MENTION_BRANDS)
    pattern = (rf"\b(?:{brands})\s+(?:(?:Air\s+Zoom\s+|Gel-?|Fresh\s+Foam\s+)?"
               rf"[a-z]+(?:\s+[a-z]+)?\s*\d+[a-z]*|(?:{rules.MENTION_SERIES})\b)")
    marked = F.regexp_replace(_clean(content), rx.java(pattern), f"{OPEN}$0{MID}")
    brand_of = lambda m: F.coalesce(*[
        F.when(F.startswith(F.lower(m), F.lit(b.lower())), F.lit(b))
        for b in rules.MENTION_BRANDS])

    def one(parts, p, i):
        match = text.trim(F.substring_index(p, MID, 1))
        rest = F.substring_index(p, MID, -1)
        brand = brand_of(match)
        model = text.trim(F.substring(match, F.length(brand) + 1, F.length(match)))
        tail = F.substring(rest, 1, 50)
        name = rx.pick(tail, r"^\s+([A-Z][a-z]+)\s*\d+[a-z]*", 1, "")
        version = rx.pick(tail, r"^\s+(?:[A-Z][a-z]+)?\s*(\d+[a-z]*)", 1, "")
        model = F.concat_ws(" ", model, F.when(version.isNotNull(), name), version)
        around = F.concat(F.right(_joined(parts, F.greatest(F.lit(1), i + 1 - 48),
                                          F.least(i + 1, F.lit(49))), F.lit(100)),
                          match, F.substring(rest, 1, 200))
        return F.struct(
            match.alias("heading"), brand.alias("brand"), model.alias("model"),
            rx.pick_num(around, rules.MENTION_PRICE).alias("price"),
            F.concat(match, F.lit("\n"), text.trim(rest)).alias("block"))
    found = text.let(F.split(marked, OPEN), lambda parts: F.transform(
        text.tail(parts), lambda p, i: one(parts, p, i)))
    return F.transform(F.filter(found, lambda m: valid_model_part(m["model"])),
                       lambda m: F.struct(
                           m["heading"].alias("heading"),
                           F.concat_ws(" ", m["brand"], m["model"]).alias("brand_model"),
                           m["price"].alias("price"), m["block"].alias("block")))


def blocks_or_mentions(df: DataFrame, content: str, keep: list[str], outer: bool = False) -> DataFrame:
    """Headed blocks of a text, or its mentions when it has no heading; `outer` as for blocks."""
    explode = F.posexplode_outer if outer else F.posexplode
    rows = text.let(headings(F.col(content)), lambda heads: F.when(
        F.size(heads) > 0, heads).otherwise(mentions(F.col(content))))
    return (df.select(*keep, explode(rows).alias("_i", "_h"))
            .select(*keep, (F.col("_i") + 1).alias("block_no"), "_h.*")
            .withColumnRenamed("price", "heading_price"))
