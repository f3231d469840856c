"""Plain-Python forms of steps that SQL does not express, written from their descriptions."""

import re

from specforge import rules


def _re(pattern, flags=re.I):
    return re.compile(pattern, flags | re.ASCII)


# --- mentions of unheaded texts (E5) ------------------------------------------------------

def _brand(match):
    return next((b for b in rules.MENTION_BRANDS if match.lower().startswith(b.lower())), None)


def _valid_model(model):
    return (2 <= len(model) <= 25 and bool(re.search(r"\d", model) or _re(rules.PART_SERIES).search(model))
            and not _re(rules.PART_INVALID_WORD).search(model) and not _re(rules.PART_INVALID_PHRASE).search(model))


def mentions(content):
    """(heading, brand_model, price, block) in text order."""
    names = "|".join(re.escape(b) + (r"\b" if len(b) <= 2 else "") for b in rules.MENTION_BRANDS)
    found = list(_re(rf"\b(?:{names})\s+(?:(?:Air\s+Zoom\s+|Gel-?|Fresh\s+Foam\s+)?[a-z]+(?:\s+[a-z]+)?\s*\d+[a-z]*"
                     rf"|(?:{rules.MENTION_SERIES})\b)").finditer(content))
    out = []
    for k, m in enumerate(found):
        end = found[k + 1].start() if k + 1 < len(found) else len(content)
        rest, match = content[m.end():end], m.group().strip()
        brand = _brand(match)
        words = [match[len(brand):].strip()]
        tail = rest[:50]
        version = re.match(r"\s+(?:[A-Z][a-z]+)?\s*(\d+[a-z]*)", tail)
        if version:
            name = re.match(r"\s+([A-Z][a-z]+)\s*\d+[a-z]*", tail)
            words += [name.group(1)] * bool(name) + [version.group(1)]
        model = " ".join(words)
        if _valid_model(model):
            around = content[max(0, m.start() - 100):m.start()] + match + rest[:200]
            price = _re(rules.MENTION_PRICE).search(around)
            out.append((match, f"{brand} {model}", float(price.group(1)) if price else None, f"{match}\n{rest.strip()}"))
    return out


# --- rows of one article ----------------------------------------------------------------

def usable(r):
    return bool(r["brand_name"] and r["model"] is not None and (r["heel_height"] or r["drop"] is not None)
                and ((r["primary_use"] or "").strip() or (r["surface_type"] or "").strip())
                and r["brand_name"] in rules.MENTION_BRANDS
                and (re.search(r"\d", r["model"]) or _re(rules.QUALITY_SERIES).search(r["model"])))


def fold(rows, kinds, keep_zero=("drop",)):
    """Each row joins the first earlier one of its brand whose name it extends, or the other way round."""
    def similar(a, b):
        x, y = sorted((a["model"].lower(), b["model"].lower()), key=len)
        return a["brand_name"].lower() == b["brand_name"].lower() and y.startswith(x) and len(y) - len(x) <= 5

    def filled(f, v):
        if v is None:
            return False
        return True if kinds[f] == "boolean" or f in keep_zero else v != "" if kinds[f] == "string" else v != 0

    out = []
    for r in rows:
        at = next((k for k, e in enumerate(out) if similar(e, r)), None)
        if at is None:
            out.append(dict(r))
            continue
        e = out[at]
        name = e["model"] if len(e["model"]) >= len(r["model"]) else r["model"]
        out[at] = {f: e[f] if filled(f, e[f]) else r[f] for f in kinds if f in r} | {"brand_name": e["brand_name"], "model": name}
    return out


def in_scope(r, scenario, brand, model):
    same = brand is not None and r["brand_name"].lower() == brand.lower()
    if scenario == "brand-only" and brand is not None:
        return same
    if scenario == "specific" and brand is not None and model is not None:
        return same and model.lower() in r["model"].lower()
    return True


def completed(rows, given, scenario, fields=("cushioning_type", "foot_width", "waterproof")):
    """Gaps of articles about one product, filled from the first response of the same name."""
    if scenario != "specific":
        return rows
    out = []
    for r in rows:
        match = next((g for g in given if g["brand_name"] is not None and g["model"] is not None
                      and g["brand_name"].lower() == r["brand_name"].lower() and g["model"].lower() == r["model"].lower()), None)
        out.append(r | {f: match[f] for f in fields if r[f] is None} if match else r)
    return out


def chosen(rows, given, scenario):
    """Numbered rows: those of the text, or the responses where it gave too few."""
    if not rows or (scenario in ("brand-only", "general") and len(rows) < 3):
        return given
    return list(enumerate(rows, 1))


# --- candidates of one article (N7) ---------------------------------------------------------

def key_words(c):
    return {w for w in re.sub("[^a-z0-9]+", " ", (c or "").lower()).split() if w not in rules.MODEL_TOKEN_STOP}


def title_score(brand, model, t_brand, t_model):
    flat = lambda c: re.sub("[^a-z0-9]+", " ", c.lower()).strip()
    score = 2 if t_brand is not None and flat(brand) == flat(t_brand) else 0
    return score if t_model is None else score + min(2, len(key_words(model) & key_words(t_model)))


def ranked_candidates(found, t_brand, t_model, confidence, single, key):
    """`found`: (brand, model, values) of the blocks in order; `key` gives a name's key."""
    rich = lambda v: sum(x is not None for x in v.values())
    titled = t_brand is not None and t_model is not None
    empty = dict.fromkeys(rules.SPEC_FIELDS)
    cands = [(b, m, v, "text") for b, m, v in found]
    if single and titled:
        same = [v for b, m, v in found if key(b, m) == key(t_brand, t_model)]
        best = max(same, key=rich) if same else empty       # the first of the richest
        cands = [(t_brand, t_model, best, "title-single" if same else "title-only")]
    elif titled and confidence >= 0.8:
        cands.append((t_brand, t_model, empty, "title"))
    cands = [c for c in cands if c[0] is not None and c[1] is not None]
    cands.sort(key=lambda c: (-title_score(c[0], c[1], t_brand, t_model), -rich(c[2]), c[3] == "title"))
    out, seen = [], set()
    for b, m, v, origin in cands:
        if key(b, m) not in seen:
            seen.add(key(b, m))
            out.append((b, m, origin, title_score(b, m, t_brand, t_model), rich(v), v))
    return out


def composed(v, fb):
    """Gaps filled from the whole text; prices by precedence, each only if plausible."""
    r2 = lambda x: None if x is None else int(x * 100 + 0.5) / 100
    pick = lambda *xs: next((x for x in xs if x is not None), None)
    low, high = rules.BOUNDS["price"]
    heel, fore = pick(v["heel_height"], fb["fb_heel"]), pick(v["forefoot_height"], fb["fb_forefoot"])
    apart = None if heel is None or fore is None else r2(heel - fore) if heel >= fore else -r2(fore - heel)
    prices = [r2(x) for x in (v["price"], fb["fb_price"], fb["odd_price"]) if x is not None and low <= x <= high]
    return v | {"heel_height": heel, "forefoot_height": fore, "drop": pick(v["drop"], fb["fb_drop"], apart),
                "weight": pick(v["weight"], fb["fb_weight"]), "price": pick(*prices)}
