"""Vocabularies, patterns, bounds, rates and presets.

Pure data, no Spark.  Every operator takes these as defaults and accepts a
replacement, so another product domain only needs other tables.  Patterns are
written in the common subset of regular expression dialects; `functions.regex`
compiles them for Spark (ASCII word boundary, full Unicode blank class).
"""

# --- fixed values: brands and dictionaries ---------------------------------
MODEL_TO_BRAND = {
    "ghost 17": "Brooks", "ghost 16": "Brooks", "caldera 8": "Brooks",
    "cloudmonster 2": "On", "cloudsurfer max": "On", "structure 26": "Nike",
    "eliot racer": "Tracksmith", "mafate 5": "Hoka", "gel-cumulus 27": "Asics",
    "endorphin speed 5": "Saucony", "fast-r nitro elite 3": "Puma",
    "kd900x ld+": "Kiprun", "x soar mont blanc carbon": "Salomon",
    "aero burst": "Asics",
}
BRAND_ALIASES = {
    "ASICS": "Asics", "HOKA": "Hoka", "PUMA": "Puma", "On Running": "On",
    "THE NORTH FACE": "The North Face", "NIKE": "Nike", "ADIDAS": "Adidas",
}
BRAND_CANON = {
    "asics": "ASICS", "hoka": "HOKA", "nike": "Nike", "adidas": "adidas",
    "new balance": "New Balance", "brooks": "Brooks", "saucony": "Saucony",
    "altra": "Altra", "on": "On", "salomon": "Salomon", "mizuno": "Mizuno",
    "inov": "inov-8", "inov-8": "inov-8", "la sportiva": "La Sportiva",
    "topo athletic": "Topo Athletic", "merrell": "Merrell", "reebok": "Reebok",
    "under armour": "Under Armour", "puma": "PUMA",
    "the north face": "The North Face", "scarpa": "SCARPA", "361°": "361°",
    "karhu": "Karhu", "craft": "Craft",
}
BLOCK_BRANDS = ["Nike", "Adidas", "Hoka", "Brooks", "Asics", "New Balance",
                "Saucony", "On", "Salomon", "Altra", "Inov8", "Mizuno", "Puma",
                "Under Armour"]
MENTION_BRANDS = BLOCK_BRANDS + ["Topo Athletic", "Skechers"]
TITLE_BRANDS = ["nike", "adidas", "hoka", "asics", "brooks", "saucony",
                "new balance", "salomon", "altra", "on", "mizuno", "puma",
                "under armour", "reebok", "inov8", "topo athletic", "scott",
                "dynafit", "la sportiva", "scarpa", "merrell"]
LOOSE_TITLE_BRANDS = ["Nike", "Adidas", "Brooks", "Asics", "ASICS",
                      "New Balance", "Hoka", "HOKA", "Saucony", "Mizuno", "Puma",
                      "PUMA", "Under Armour", "Salomon", "Merrell", "Altra",
                      "Topo Athletic", "On", "On Running", "Allbirds", "Vans",
                      "Converse", "Reebok", "La Sportiva", "Inov8", "Inov-8",
                      "Arc'teryx", "The North Face", "Decathlon", "Kailas",
                      "Scott", "Craft", "Tracksmith", "Lululemon"]
ANYWHERE_BRANDS = ["Asics", "Nike", "Adidas", "Brooks", "Hoka", "Saucony",
                   "New Balance", "On", "Puma", "Mizuno", "Salomon", "Altra",
                   "Reebok", "Inov-8", "Skechers", "Under Armour",
                   "Topo Athletic", "Karhu", "Craft", "361", "361°", "Merrell",
                   "Norda", "NNormal", "Kiprun", "Decathlon", "Scott", "Diadora",
                   "Vibram", "Tracksmith", "La Sportiva", "Mount to Coast",
                   "Kailas", "Li-Ning", "Li Ning"]
FOOTWEAR_BRANDS = ["nike", "adidas", "asics", "brooks", "saucony", "hoka",
                   "new balance", "mizuno", "puma", "reebok", "salomon", "altra",
                   "topo athletic", "on", "allbirds", "vans", "converse",
                   "jordan"]
EXCLUDED_BRANDS = ["garmin", "polar", "suunto", "fitbit", "apple", "samsung",
                   "music", "spotify", "strava", "app", "google", "amazon",
                   "gopro", "camera", "video", "the_north_face", "patagonia",
                   "columbia"]

# --- fixed values: units, rates, bounds ------------------------------------
OZ_TO_GRAMS = 28.35          # unit helper
OZ_TO_GRAMS_TEXT = 28.3495   # text extraction
USD_RATES = {"USD": 1.0, "EUR": 1.08, "GBP": 1.26, "CAD": 0.74, "AUD": 0.67,
             "JPY": 0.0068, "CHF": 1.10, "SEK": 0.095, "NOK": 0.095,
             "DKK": 0.145, "PLN": 0.25}
TABLE_USD_RATES = {"USD": 1.0, "EUR": 1.08, "GBP": 1.25}
CURRENCY_PATTERNS = [
    (r"\$\s*\d|\bUSD\b", "USD"), (r"€\s*\d|\bEUR\b", "EUR"),
    (r"£\s*\d|\bGBP\b", "GBP"), (r"\bJPY\b|¥\s*\d", "JPY"),
    (r"\bCAD\b", "CAD"), (r"\bAUD\b", "AUD"), (r"\bCHF\b", "CHF"),
    (r"\bSEK\b", "SEK"), (r"\bNOK\b", "NOK"), (r"\bDKK\b", "DKK"),
    (r"\bPLN\b", "PLN"),
]
BOUNDS = {"height": (10, 60), "weight": (100, 600), "drop": (0, 20),
          "price": (40, 500)}
LEGACY_BOUNDS = {"heel": (10, 70), "forefoot": (5, 50), "weight": (100, 700),
                 "drop": (-5, 25), "price": (30, 600)}

# --- fixed values: product columns -----------------------------------------
NUMERIC_FIELDS = ["heel_height", "forefoot_height", "drop", "weight", "price"]
BOOLEAN_FIELDS = ["carbon_plate", "waterproof"]
TEXT_FIELDS = ["upper_breathability", "primary_use", "cushioning_type",
               "surface_type", "foot_width", "additional_features"]
SPEC_FIELDS = ["heel_height", "forefoot_height", "drop", "weight", "price",
               "upper_breathability", "carbon_plate", "waterproof",
               "primary_use", "cushioning_type", "surface_type", "foot_width",
               "additional_features"]
ENUMS = {"upper_breathability": ["low", "medium", "high"],
         "cushioning_type": ["firm", "balanced", "max"],
         "surface_type": ["road", "trail"],
         "foot_width": ["narrow", "standard", "wide"]}
RICHER_WEIGHTS = {"brand_name": 2, "model": 2, "weight": 2, "drop": 2,
                  "price": 2}
PLACEHOLDERS = ["not mentioned", "none", "n/a", "unknown", ""]
CRITICAL_FIELDS = ["primary_use", "cushioning_type", "weight", "foot_width",
                   "heel_height", "drop", "waterproof"]
STAGING_ONLY = ["id", "created_at", "is_edited", "is_running_shoe"]

# --- fixed values: vocabulary maps, first match wins -----------------------
VOCAB = {
    "cushioning": [(r"max|plush|high", "max"), (r"firm|stiff", "firm"),
                   (r"balanced|moderate|middle|medium", "balanced")],
    "cushioning_loose": [(r"firm|stiff", "firm"), (r"max|plush|high", "max"),
                         (r"balanced|moderate|medium", "balanced")],
    "cushioning_sheet": [(r"firm|minimal", "firm"),
                         (r"balanced|moderate|average|responsive", "balanced"),
                         (r"max|plush|soft|cushioned", "max")],
    "surface": [(r"trail", "trail"), (r"road|asphalt|pavement", "road")],
    "surface_loose": [(r"trail", "trail"), (r"road", "road")],
    "width": [(r"narrow|slim", "narrow"), (r"wide|2e|4e", "wide"),
              (r"standard|regular|d width|medium", "standard")],
    "width_loose": [(r"narrow|slim", "narrow"), (r"wide|2e|4e", "wide"),
                    (r"standard|regular|medium", "standard")],
    "breathability": [(r"high|excellent|great", "high"), (r"low|poor", "low"),
                      (r"medium|moderate|average", "medium")],
    "use": [(r"daily|trainer", "daily trainer"), (r"tempo", "tempo"),
            (r"race", "race"), (r"trail", "trail")],
    "plate": [(r"carbon|plate", True), (r"no", False)],
    "waterproof": [(r"gore-tex|waterproof|water-resistant", True),
                   (r"no", False)],
    "boolean_text": [(r"true|yes", True), (r"false|no", False)],
}
SHEET_EXACT = {
    "breathability": {"low": "low", "medium": "medium", "high": "high"},
    "width": {"narrow": "narrow", "normal": "standard", "wide": "wide"},
    "surface": {"road": "road", "trail": "trail"},
}

# --- fixed values: relevance vocabularies ----------------------------------
SHOE_TERMS = [r"\bshoe", r"\bsneaker", r"\btrainer", r"\bfootwear",
              r"\brunning\s+shoe", r"\btrail\s+shoe", r"\brace\s+shoe",
              "кроссовк", "обувь", r"беговая\s+обувь", "laufschuh", "chaussure",
              "zapatilla", "calzado", "tênis"]
REVIEW_TERMS = [r"\breview\b", r"\btest\b", r"\btester\b", r"\bhands-on\b",
                r"\bfirst look\b", r"\b(?:vs|versus)\b", r"\bcomparison\b",
                r"\btested\b", r"\binitial\b", "обзор", "тест"]
# The bounded form of the short terms; `NON_SHOE_TERMS_SUBSTRING` keeps them
# as plain substrings ("what" contains "hat").
NON_SHOE_TERMS_SUBSTRING = [
    "smartwatch", r"\bwatch(?:es)?\b", r"fitness\s+tracker", "часы",
    "headphone", r"earbuds?", "sunglasses", "очки", r"socks?", "носки",
    r"hydration\s+pack", "vest", "jacket", "куртка", r"shorts?", "шорты",
    r"tights?", r"pants?", r"leggings?", "штаны", r"massage\s+gun", "treadmill",
    r"беговая\s+дорожка", r"bike\s+trainer", "cycling", "велосипед", "backpack",
    "рюкзак", "belt", "armband", "hat", "cap", "шапка", r"gloves?", "перчатки",
    "bra", r"sports\s+bra", "nutrition", "питание", r"energy\s+gel",
    "supplement", "protein", r"recovery\s+drink"]
NON_SHOE_BOUNDED = ["vest", "hat", "cap", "bra", "belt", r"shorts?", r"tights?",
                    r"pants?"]
NON_SHOE_TERMS = [rf"\b{t}\b" if t in NON_SHOE_BOUNDED else t
                  for t in NON_SHOE_TERMS_SUBSTRING]
CHARACTERISTIC_PATTERNS = [
    r"stack\s+height", r"heel\s+height", r"forefoot\s+height",
    r"\b\d+\s*mm\s+drop", r"\bdrop\s*:\s*\d+", r"weight\s*:\s*\d+", r"\d+\s*oz",
    r"\d+\s*g(?:rams)?", r"вес\s*:\s*\d+", "cushion", "midsole", "амортизация",
    r"price\s*:\s*[$€£]", r"\$\d{2,3}", r"цена\s*:", r"carbon\s+plate",
    r"carbon\s+fiber", r"карбоновая\s+пластина", r"gore-?tex", "gtx",
    "waterproof", r"water-?resistant", "водонепроницаем", "outsole", "traction",
    "grip", "подошва"]
SHOE_WORDS = (r"\b(?:shoe|shoes|sneaker|sneakers|runner|runners|running\s+shoe"
              r"|footwear|kicks)\b")
CONTEXT_WORDS = (r"\b(?:review|test|comparison|guide|best|top|rated|comfortable"
                 r"|cushioning|support|trail|road|marathon|jogging|training"
                 r"|athletic|sports?)\b")
EXCLUSION_WORDS = (r"\b(?:boot|boots|sandal|sandals|high\s+heel|dress\s+shoe"
                   r"|formal|oxford|loafer|pump|stiletto|cleat|cleats)\b")

# --- fixed values: weighted prefilter --------------------------------------
SCORE_HIGH = ["midsole", "outsole", "heel-to-toe drop", "stack height",
              "forefoot", "heel", "toe box", "lugs", "running shoe",
              "trail shoe", "sneaker", "pronation", "supination", "neutral",
              "stability", "carbon plate", "waterproof", "breathable",
              "traction", "grip", "upper"]
SCORE_MEDIUM = ["shoe", "running", "trail", "sneaker", "runner", "jog", "run",
                "athletic", "footwear", "cushion", "sole"]
SCORE_LOW = ["mm", "oz", "g", "MSRP", "$", "price", "weight"]
SCORE_NEGATIVE = [
    "bike", "cycling", "ski", "snowboard", "jacket", "pants", "tee", "shirt",
    "backpack", "watch", "gps", "phone", "headphones", "nutrition", "hotel",
    "recipe", "cooking", "travel", "book", "movie", "music", "software", "car",
    "battery", "charger", "laptop", "tablet", "tv", "television", "furniture",
    "appliance", "garden", "tool", "paint", "fabric", "poles", "tent",
    "sleeping bag", "camping", "hiking", "backpacking", "fishing", "swimming",
    "surfing", "yoga", "pilates", "meditation", "camera", "lens", "drone",
    "gaming", "console", "controller", "keyboard", "mouse"]
SCORE_WEIGHTS = {"high": 3.0, "medium": 2.0, "low": 0.5, "negative": 3.0}
SCORE_CAP = 3
SCORE_MIN = 8.0
SCORE_NEGATIVE_MAX = 6.0
ANCHOR_BONUS = 5.0
ANCHOR_PATTERNS = [r"heel[-\s]?to[-\s]?toe\s+drop",
                   r"\bdrop\b.{0,30}\b\d{1,2}\s*mm\b",
                   r"\bheel\b.{0,60}\bforefoot\b.{0,40}\b\d{1,2}\s*mm\b",
                   r"\bstack\s+height\b"]
EVIDENCE_PATTERNS = [(r"\$\d+", "$", "price indication"),
                     (r"\d+\s*mm", "mm", "mm measurements"),
                     (r"\d+\s*(?:g|grams|oz|ounces)", "g", "weight measurements")]
TITLE_NEGATIVES = [
    "headphones", "earbud", "earbuds", "watch", "garmin", "gps watch",
    "water bottle", "handheld bottle", "hydration bottle", "massage gun",
    "percussion therapy", "treadmill", "socks", "shorts", "jacket", "vest",
    "belt", "pack", "headlamp", "light", "nutrition", "gels", "poles", "best",
    "watches", "bottles", "massage guns", "gift ideas", "holiday gift guide"]
TITLE_POSITIVES = ["shoe", "shoes", "sneaker", "running shoe", "trail shoe",
                   "trainer"]
TITLE_COMPOUNDS = [(["best", "watches"], "best_watches_pattern"),
                   (["best", "bottles"], "best_bottles_pattern"),
                   (["best", "massage guns"], "best_massage_guns_pattern"),
                   (["gift ideas"], "gift_ideas"),
                   (["holiday gift guide"], "holiday_gift_guide")]

# --- fixed values: irrelevance reasons -------------------------------------
LISTICLE = (r"^(?:best|top|our (?:favorite|favourites)|roundup|buying guide"
            r"|gift guide|right now|top picks|editor(?:'|s)? choice"
            r"|what to buy)\b")
APPAREL = (r"\b(?:t-?shirt|tee|shirt|shorts?|tights?|bra|singlet|jersey|jacket"
           r"|vest|pants|trousers|hoodie|socks?|gloves?|hat|beanie|cap|headband"
           r"|belt|hydration|pack|backpack|poles?|watch|headlamp|gaiters?"
           r"|nutrition|treadmill|strollers?|joggers?|stroller)\b")
NON_SHOE = r"\b(?:sandals?|slides?|slippers?|boots?)\b"
BAD_BRAND = (r"^(?:best|the|our|editor(?:'|s)?|guide|review|test|from|by|how|why"
             r"|when|where|never|stability|trail|running|shoes?|type|every"
             r"|beginners?|stable|fun|delivers?|both|good|great|right|\d+)$")
BAD_MODEL = (r"\b(?:shoes? for every type of runner"
             r"|running shoes? for beginners?|shoe that'?s stable and fun"
             r"|delivers? both|for every type|type of runner|for beginners?"
             r"|stable and fun)\b")

# --- fixed values: product type gate ---------------------------------------
NON_SNEAKER_KEYWORDS = [
    "jacket", "куртка", "shirt", "рубашка", "hoodie", "худи", "sweater",
    "свитер", "pants", "штаны", "shorts", "шорты", "tights", "леггинсы", "vest",
    "жилет", "cap", "кепка", "hat", "шляпа", "beanie", "шапка", "gloves",
    "перчатки", "watch", "часы", "belt", "ремень", "bag", "сумка", "backpack",
    "рюкзак", "sock", "носки", "insole", "стелька", "стельки", "laces",
    "шнурки", "cleaner", "очиститель", "spray", "спрей", "treadmill",
    "беговая дорожка", "tracker", "трекер", "monitor", "монитор", "headphones",
    "наушники", "earbuds", "bottle", "бутылка", "windbreaker", "ветровка",
    "raincoat", "дождевик", "compression", "компрессионная", "sleeve", "рукав",
    "band", "повязка"]
SNEAKER_KEYWORDS = ["shoe", "кроссовки", "кроссовок", "sneaker", "runner",
                    "running", "беговые", "trainer", "тренировочные", "boot",
                    "ботинки", "sandal", "сандали", "flip", "шлепки", "клипы",
                    "spikes", "шиповки", "cleats", "бутсы"]
FOOTWEAR_PATTERNS = [r"\d+(?:\.\d+)?\s*(?:mm|мм)\s*(?:drop|дроп)",
                     r"\d+(?:\.\d+)?\s*(?:mm|мм)\s*(?:heel|пятка)",
                     r"\d+(?:\.\d+)?\s*(?:g|гр|gram|грамм)",
                     r"air|gel|boost|zoom|react|dna|fresh|foam",
                     r"trail|road|track|racing|daily"]
CLEANUP_RULES = [
    ("brand_name", "headphone", "headphones"), ("brand_name", r"earbuds?", "earbuds"),
    ("model", "headphone", "headphones"), ("model", r"earbuds?", "earbuds"),
    ("model", r"watch(?:es)?", "watches"), ("model", "sunglasses", "sunglasses"),
    ("model", r"hydration\s+pack", "hydration packs"), ("model", "vest", "vests"),
    ("model", "jacket", "jackets"), ("model", r"shorts?", "shorts"),
    ("model", r"tights?", "tights"), ("model", r"massage\s+gun", "massage guns"),
    ("model", "treadmill", "treadmills"), ("model", "backpack", "backpacks"),
    ("model", "belt", "belts"), ("model", "armband", "armbands"),
    ("model", "hat", "hats"), ("model", "cap", "caps"),
    ("model", r"gloves?", "gloves"), ("model", "bra", "bras"),
    ("primary_use", "hydration pack", "hydration packs"),
    ("primary_use", "accessory", "accessories"),
    ("primary_use", "apparel", "apparel"), ("primary_use", "nutrition", "nutrition"),
]
INVALID_MODELS = (r"^(?:shoe|shoes|sneaker|trainer|running|review|test"
                  r"|performance|comparison)$")
SUSPICIOUS = [r"<script", r"javascript:", r"on\w+\s*=", r"eval\s*\(",
              r"function\s*\(", r"\$\{", r"import\s+", r"require\s*\("]

# --- fixed values: headings and blocks -------------------------------------
HEADING = (r"^(?:Best\s+)?(?:Road|Trail)?\s*(?:Running\s+)?Shoes?[^:]*?[:—-]\s*"
           r"([^(\n]+?)(?:\s*\([^)]*\$(\d{2,4})[^)]*\))?\s*$")
HEADING_PREFIX = r"^(?:Runner-Up|Winner|Pick|Choice|Selection):\s*"
HEADING_GENERIC = (r"^(?:millimeter|grams?|ounces?|features?|offers?|weighs?"
                   r"|stack|height|lugs|vibram|compound|outsole)")
PRICE_IN_BLOCK = [r"\(\s*\$?\s*(\d{2,4})\s*\)", r"\b\$\s*(\d{2,4})\b"]
NUM = r"(\d+(?:\.\d+)?)"
WEIGHT_PATTERNS = [
    (r"offiziell[:\s]+(\d{2,4})\s*g\b", 1, "g"),
    (r"gewicht[:\s]+(\d{2,4})\s*g\b", 1, "g"),
    (r"(\d+(?:\.\d+)?)\s*(?:ounces?|oz)\s*\((\d+)\s*grams?\)", 2, "g"),
    (r"weight[:\s]+(\d{2,4})\s*g\b", 1, "g"),
    (r"\b(\d{2,4})\s*grams?\b", 1, "g"),
    (r"\b(\d+(?:\.\d+)?)\s*(?:ounces?|oz)\b", 1, "oz"),
]
PAIR_PATTERNS = [  # (pattern, heel group, forefoot group); first match ends
    (rf"stack\s+height\s*/?\s*drop[^0-9]*{NUM}\s*mm\s+in\s+heel[^0-9]+{NUM}\s*mm\s+in\s+forefoot", 1, 2),
    (rf"{NUM}\s*[–-]\s*{NUM}\s*millimeters?", 1, 2),
    (rf"{NUM}\s*mm\s+vorfu[ßs]?[^0-9]+{NUM}\s*mm\s*ferse", 2, 1),
    (rf"{NUM}\s*mm\s*ferse[^0-9]+{NUM}\s*mm\s+vorfu[ßs]?", 1, 2),
    (rf"{NUM}\s*mm\s+in\s+heel[^0-9]+{NUM}\s*mm\s+in\s+forefoot", 1, 2),
]
HEEL_AT_HEEL = rf"{NUM}[^0-9]*millimeters?\s*stack\s*height\s*at\s*the\s*heel"
HEEL_GENERAL = rf"{NUM}[^0-9]*millimeters?[^.]*(?:heel|stack\s*height)(?!\s*drop)"
FOREFOOT_GENERAL = rf"{NUM}[^0-9]*millimeters?[^.]*forefoot"
BOTH_HEIGHTS = (rf"{NUM}[^0-9]*millimeters?\s*heel[^0-9]+{NUM}[^0-9]*"
                r"millimeters?\s*forefoot")
STACK_GENERAL = rf"{NUM}[^0-9]*millimeters?\s*(?:stack|height)(?!\s*drop)"
DROP_PATTERNS = [
    rf"{NUM}\s*(?:millimeters?|mm)\s*drop",
    rf"drop\s+is\s+{NUM}\s*(?:millimeters?|mm)",
    rf"with\s+an?\s+{NUM}[^0-9]*(?:millimeters?|mm)\s*drop",
    rf"drop[:\s]+{NUM}\s*(?:millimeters?|mm)",
    rf"sprengung[:\s]+{NUM}\s*mm",
    rf"\({NUM}\s*mm\s*drop\)",
]
ZERO_DROP = r"zero[^a-z]*drop|0[^a-z]*drop|zero.drop"
CLASSIC_WEIGHT_PATTERNS = WEIGHT_PATTERNS[2:3] + WEIGHT_PATTERNS[4:]
CLASSIC_PAIR_PATTERNS = PAIR_PATTERNS[1:2]
CLASSIC_DROP_PATTERNS = [
    rf"{NUM}[^0-9]*millimeters?\s*drop",
    rf"drop\s+is\s+{NUM}\s*millimeters?",
    rf"with\s+an?\s+{NUM}[^0-9]*millimeters?\s*drop",
]
USE_SPECIFIC = [(r"tempo|speed|racing", "tempo"),
                (r"daily|training|trainer", "daily trainer"),
                (r"recovery", "recovery")]
WATERPROOF_MENTION = (r"\b(not\s+)?(?:gore[\s\S]*tex|gtx|waterproof"
                      r"|water[\s\S]*resistant)\b")
WATERPROOF_NEGATION = r"\b(?:not|no|non)[^.]*?water(?:proof|resistant)"
CARBON_MENTION = r"carbon[\s\S]*plate|carbon[\s\S]*fiber"
CARBON_PARTS = ["plate", "fiber"]
# The parts of WATERPROOF_MENTION: literal, word, what must follow somewhere behind it.
WATERPROOF_WORDS = [("gore", "gore", "tex"), ("gtx", r"gtx\b", None), ("waterproof", r"waterproof\b", None),
                    ("water", "water", "resistant")]
NEGATION_START = r"\b(?:not|no|non)"
WATERPROOF_END = "water(?:proof|resistant)"

# --- fixed values: series names --------------------------------------------
MENTION_SERIES = (
    r"Air\s+Zoom\s+Pegasus|Wave\s+Rider|Aero\s+Spark|Pegasus|Ghost|Clifton"
    r"|Speedgoat|Nimbus|Kayano|Cumulus|Structure|Vomero|React|Infinity|Turbo"
    r"|Tempo|Free|Revolution|Downshifter|Blazer|Cortez|Waffle|Zoom|Air\s+Max"
    r"|Air\s+Force|Gel-Nimbus|Gel-Kayano|Gel-Cumulus|GT-\d+|Fresh\s+Foam"
    r"|FuelCell|MORE|Beacon|Rebel|Arishi|Minimus|Trail|Hierro|Summit|Ultraboost"
    r"|Supernova|Takumi\s+Sen|Adios\s+Pro|Adizero|Duramo\s+SL|Pro\s+Evo|Boston"
    r"|Solarboost|Alphaboost|Pureboost|Response|Galaxy|Duramo|4D|NMD|Stan\s+Smith"
    r"|Superstar|Gazelle|Campus|Continental|Solar|Edge|EQT|POD|Yeezy|Boost|ZX"
    r"|Energy|Cloud|Cloudstratus|Cloudflow|Cloudswift|Cloudsurfer|Cloudflyer"
    r"|Cloudrush|Cloudventure|Cloudace|Pulse|Endorphin|Kinvara|Guide|Hurricane"
    r"|Triumph|Cohesion|Grid|Jazz|Shadow|Peregrine|Xodus|Switchback|Mad\s+River"
    r"|Bondi|Arahi|Rincon|Mach|Carbon\s+X|Challenger|Tecton|Torrent|Evo|Kawana"
    r"|Transport|Solimar|Kaha|Ora|Slide|Clifton\s+Edge|Akasa|Skyward|Mafate"
    r"|Lone\s+Peak|Escalante|Rivera|Paradigm|Provision|Torin|Timp|Olympus|King"
    r"|Superior|Mont\s+Blanc|Cross|Lone|Via|Race|Repeat|X-Mission|Sense|Predict"
    r"|Outpath|Alphacross|Speedcross|Wildcross|Supercross|Ultra|Sonic|Inspire"
    r"|Horizon|Prophecy|Creation|Paradox|Ultima|Sky|Alchemy|Connect|Catalyst"
    r"|Precog|RunBird|Vapor|Streak|Rival|Victory|Zoom\s+Fly|Alphafly|Vaporfly"
    r"|ZoomX|Invincible|Ultrafly")
PART_SERIES = (
    "pegasus|ghost|clifton|speedgoat|nimbus|kayano|cumulus|structure|vomero"
    "|react|infinity|turbo|tempo|free|revolution|downshifter|blazer|cortez"
    "|waffle|zoom|air|gel|fresh|fuelcell|more|beacon|rebel|arishi|minimus|trail"
    "|hierro|summit|ultraboost|nmd|stan|superstar|gazelle|campus|continental"
    "|solar|edge|alphaboost|pureboost|response|galaxy|duramo|eqt|pod|yeezy|boost"
    "|energy|cloud|pulse|endorphin|kinvara|ride|guide|hurricane|triumph|cohesion"
    "|grid|jazz|shadow|peregrine|xodus|switchback|mad|bondi|arahi|rincon|mach"
    "|carbon|challenger|tecton|torrent|evo|kawana|transport|solimar|kaha|ora"
    "|slide|akasa|skyward|mafate|lone|escalante|rivera|paradigm|provision|torin"
    "|timp|olympus|king|superior|mont|cross|repeat|mission|sense|predict|outpath"
    "|alphacross|speedcross|wildcross|supercross|ultra|sonic|aero|wave|rider"
    "|inspire|horizon|prophecy|creation|paradox|ultima|sky|alchemy|connect"
    "|catalyst|precog|runbird|vapor|streak|rival|victory|fly|alphafly|vaporfly"
    "|zoomx|invincible|ultrafly")
PART_INVALID_WORD = (
    r"^(?:version|model|option|design|iteration|offering|lineup|system"
    r"|technology|innovation|engineering|development|has|enhanced|latest"
    r"|improved|updated|moved|added|nailed|redesigned|developed|stability"
    r"|cushioning|trainer|lightweight|maximum|shoe|shoes|running|trail|road"
    r"|features|offers|provides|delivers|weighs|measures|boasts)$")
PART_INVALID_PHRASE = (
    "moved|enhanced|improved|updated|added|nailed|redesigned|developed|has"
    "|offers|provides|delivers|features|weighs|measures|boasts|latest|newest"
    "|signature|daily|trainer|lineup|offering|system|technology|innovation"
    "|engineering|development")
QUALITY_SERIES = (
    "^(?:Air|Gel|Fresh|Wave|Cloud|Ultra|Pure|Solar|Alpha|React|Zoom|Infinity"
    "|Turbo|Tempo|Free|Revolution|Downshifter|Blazer|Cortez|Waffle|Pegasus|Ghost"
    "|Clifton|Speedgoat|Nimbus|Kayano|Cumulus|Structure|Vomero|Bondi|Arahi"
    "|Rincon|Mach|Challenger|Torrent|Evo|Endorphin|Kinvara|Ride|Guide|Hurricane"
    "|Triumph|Peregrine|Xodus|Lone|Escalante|Rivera|Paradigm|Torin|Timp|Olympus"
    "|Sense|Predict|Speedcross|Wildcross|Supercross|Sonic|Aero|Rider|Inspire"
    "|Horizon|Prophecy|Creation|Paradox|Ultima|Sky|Vapor|Streak|Rival|Victory"
    "|Alphafly|Vaporfly|ZoomX|Invincible|Ultraboost|Supernova|Takumi|Adios"
    "|Adizero|Duramo|Boston|Solarboost|Alphaboost|Pureboost|Response|Galaxy|Pro)")
MENTION_PRICE = r"(?:Price[:\s]*|Retail\s+price[:\s]*|costs?\s*|\$)(\d{2,4})\b"

# --- fixed values: title parsing -------------------------------------------
TITLE_REVIEW = "review|test|hands-on|first look"
TITLE_STOP_PREFIXES = [
    "review", "first look", "first impressions", "hands-on", "test",
    "rtr review", "превью", "обзор", "тест", "первый взгляд", "beoordeling",
    "recensie", "recension", "recensione", "avis", "analyse", "analysis",
    "prueba", "testbericht", "in depth"]
TITLE_PREPOSITIONS = [
    "of", "van", "von", "vom", "sur", "sobre", "de", "del", "della", "dei",
    "delle", "du", "des", "der", "den", "das", "la", "le", "los", "las", "el",
    "l'"]
TITLE_STOP_HEAD = (r"\b(?:a|an|the|this|that|these|those|our|my|your|le|la|les"
                   r"|un|une|el|los|las|der|die|das|from|by|how|why|when|where"
                   r"|never|always|best)\b")
TITLE_AFTER_NOISE = (r"\b(?:the|a|an|that|that's|is|are|was|were|will|can|could"
                     r"|should|delivers?|brings?|makes?|isn'?t|aren'?t|yep|yes"
                     r"|no|but|and|or|with|without)\b")
TITLE_HEAD_WHITELIST = [r"^the\s+north\s+face\b", r"^la\s+sportiva\b",
                        r"^mount\s+to\s+coast\b"]
TITLE_TWO_WORD_BRANDS = [("li", "ning", "Li-Ning"),
                         ("under", "armour", "Under Armour"),
                         ("new", "balance", "New Balance"),
                         ("la", "sportiva", "La Sportiva")]
TITLE_SECOND_WORDS = ["north", "face", "sportiva", "balance", "one", "athletic",
                      "armour"]
LOOSE_NON_SHOE = ["headphone", r"earbuds?", r"watch(?:es)?", "sunglasses",
                  r"socks?", r"hydration\s+pack", "vest", "jacket", r"shorts?",
                  r"tights?", r"massage\s+gun", "treadmill", "backpack", "belt",
                  "armband", "hat", "cap", r"gloves?", "bra"]
LOOSE_GENERAL = [r"best\s+running\s+shoes", r"top\s+\d+\s+shoes",
                 r"running\s+shoes\s+for", r"shoes?\s+comparison",
                 r"\d+\s+best\s+shoes", r"beginner.+shoes", r"shoes.+guide"]
LOOSE_MODEL = (r"^[\s\-:]*([\w\s\-+./]+?)(?:\s*(?:review|test|vs|comparison"
               r"|guide|running|shoe|trainer|multi\s+tester|performance)|$)")
LOOSE_NOT_MODEL = (r"^(?:running|shoes?|trainer|sneaker|collection|range|line"
                   r"|series)$")
LOOSE_MODEL_WORDS = (r"\b(?:max|pro|elite|ultra|speed|ghost|gel|air|boost|wave"
                     r"|glycerin|pegasus|cumulus|nimbus)\b")
LOOSE_VERSION = r"\bv\d+|\b\d+\.\d+|\w\s+\d{1,2}(?:\s|$)"
LOOSE_COLLECTION = "best|top|collection|range|shoes"
MODEL_NOISE_SUFFIX = r"\s+(?:review|test|performance|running|shoe|trainer)$"
PHRASE_STOP = ["With", "And", "The", "This", "That", "Review", "RTR", "First",
               "Impressions"]
MODEL_TOKEN_STOP = ["the", "and", "with", "for", "pro", "max", "gtx", "carbon",
                    "plate"]
MENTION_WORD_STOP = ["the", "and", "or", "in", "on", "at", "for", "with"]

# --- fixed values: whole-text fallback -------------------------------------
FALLBACK_PAIRS = [
    r"(?:stack|height|stack height)[^.\d]{0,20}(\d{2}(?:\.\d+)?)\s*mm[^.\d]{0,40}(\d{2}(?:\.\d+)?)\s*mm",
    r"(\d{2}(?:\.\d+)?)\s*/\s*(\d{2}(?:\.\d+)?)\s*mm"]
FALLBACK_HEEL = (r"(?:heel[^.\d]{0,12}|at the heel[^.\d]{0,12}"
                 r"|stack[^.\d]{0,12})\b(\d{2}(?:\.\d+)?)\s*mm")
FALLBACK_FOREFOOT = (r"(?:forefoot[^.\d]{0,12}|at the forefoot[^.\d]{0,12}"
                     r"|toe[^.\d]{0,12})\b(\d{2}(?:\.\d+)?)\s*mm")
FALLBACK_DROP = r"(?:drop[^.\d]{0,6}|)\b(\d{1,2}(?:\.\d+)?)\s*mm\s*(?:drop)?"
FALLBACK_PLATFORM = r"\b(?:platform|stacked)\b"
FALLBACK_GRAMS = r"(\d{2,3}(?:\.\d+)?)\s*g\b"
FALLBACK_OZ = r"(\d{1,2}(?:\.\d+)?)\s*oz\b"
FALLBACK_MONEY = [(r"\$\s*(\d{2,3}(?:\.\d+)?)", "USD"),
                  (r"€\s*(\d{2,3}(?:\.\d+)?)", "EUR"),
                  (r"£\s*(\d{2,3}(?:\.\d+)?)", "GBP"),
                  (r"\bUSD\s*(\d{2,3}(?:\.\d+)?)", "USD"),
                  (r"\bEUR\s*(\d{2,3}(?:\.\d+)?)", "EUR"),
                  (r"\bGBP\s*(\d{2,3}(?:\.\d+)?)", "GBP")]
WEIRD_PRICE = r"(\d{2,3})\s*,\s*\$(\d{2,3})"

# --- fixed values: article windows, values, snippets -----------------------
WINDOW_TERMS = ["drop", "stack", "heel", "forefoot", "weight", "$", "msrp",
                "mm", "oz", "g"]
WINDOW_RADIUS = 4000
VALUE_PATTERNS = {  # field: (pattern, low, high)
    "price": (r"\$(\d{2,4})(?:\.\d{2})?", 50, 500),
    "drop": (r"\bdrop\s*[:\-]?\s*(\d{1,2})\s*mm(?=[^a-z0-9_]|[a-z]|$)", 0, 25),
    "stack": (r"stack\s*height\s*[:\-]?\s*(\d{2})\s*mm", 5, 60),
    "grams": (r"(\d{2,4})\s*(?:g|grams)\b", 50, 1000),
    "oz": (r"(\d{1,2}(?:\.\d)?)\s*(?:oz|ounces)\b", 3, 30),
    "heel": (r"\d{2}\s*mm.*heel|heel.*\d{2}\s*mm", 5, 60),
    "forefoot": (r"\d{2}\s*mm.*forefoot|forefoot.*\d{2}\s*mm", 5, 60),
}
SNIPPET_RADIUS = 200
SNIPPET_SCORES = [(r"\b\d+\s*(?:g|grams|oz|ounces)\b", 2),
                  (r"\bdrop\s*[:\-]?\s*\d{1,2}\s*mm\b", 2),
                  (r"\$\d+", 1)]
SNIPPET_HEIGHT = (r"\d+\s*mm", "heel|forefoot", 2)  # both in one line
SNIPPET_ANCHORS = ["stack", "drop", "heel", "forefoot", "weight"]
CLUSTER_DROP = r"\bdrop\s*[:\-]?\s*(\d{1,2})\s*mm\b"
MIN_CONTENT_CHARS = 2000
MAX_HTML_CHARS = 600000
LINE_TAGS = ("p div br li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table tr td th section article header footer "
             "nav aside main figure blockquote pre hr").split()
PARSED_CHARS = 1 << 20    # pages whose parsed form a task holds at once; no page is cut

# --- fixed values: comparison tables ---------------------------------------
TABLE_KEYWORDS = ["weight", "heel drop", "drop", "stack", "heel", "forefoot",
                  "price", "retail price"]

# --- fixed values: legacy title gate, prompts, resolver --------------------
TOKEN_PRICE_IN = 0.00015
TOKEN_PRICE_OUT = 0.0006

# --- fixed values: search ---------------------------------------------------
SEARCH_DEFAULTS = {"price": (50, 1000), "weight": (100, 500), "drop": (0, 20)}
SEARCH_PRESETS = {
    "Racing Shoes": dict(use=["racing"], plate="with", weight=(180, 250),
                         sort="weight_asc"),
    "Trail Running": dict(surface=["trail"], sort="price_asc"),
    "Budget Friendly": dict(price=(50, 120), sort="price_asc"),
    "Max Cushion": dict(cushioning=["max"], drop=(6, 12), sort="price_asc"),
    "Daily Trainers": dict(use=["daily trainer"], surface=["road"],
                           price=(100, 180), sort="price_asc"),
}
PAGE_COLUMNS = ["brand", "model", "use", "surface", "heel", "forefoot", "drop",
                "weight", "price", "plate", "waterproof", "cushioning", "width",
                "breathability", "date", "source"]
LATEST_COLUMNS = ["brand_name", "model", "primary_use", "cushioning_type",
                  "heel_height", "forefoot_height", "weight", "foot_width",
                  "drop", "surface_type", "upper_breathability", "carbon_plate",
                  "waterproof", "price", "additional_features", "source_link",
                  "article_id", "date"]
