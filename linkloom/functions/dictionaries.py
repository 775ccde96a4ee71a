"""Fixed values of the linkage rules. Larger or local dictionaries (brands, tokens,
stop words, further forms) are tables, loaded with ``linkloom.sources.catalog``."""

# Dose and volume units.
UNITS = ("mg", "mcg", "ml", "gm", "l", "kg", "iu", "cc")
DOSE_UNITS = ("mg", "mcg", "gm", "iu")

# Dosage forms and common pack words; extend with a table.
FORMS = (
    "tab", "cap", "syrup", "cream", "ointment", "gel", "drops", "spray", "injectable", "supp", "sachet", "suspension", "solution", "eff",
    "infant", "powder", "lotion", "paste", "shampoo", "conditioner", "oil", "serum", "mask", "soap", "wash", "stick", "perfume", "cleanser",
    "mouthwash", "bottle", "liniment", "deodorant", "pads", "diapers", "wipes", "toothpaste", "scrub", "foam", "liquid", "strips", "lozenges",
    "effervescent", "plus", "size", "device", "large", "small", "medium", "piece",
)

# Abbreviations of English names.
ABBREVIATIONS = {
    "tab": "tab", "tabs": "tab", "tablet": "tab", "tablets": "tab", "t": "tab", "t.": "tab",
    "cap": "cap", "caps": "cap", "capsule": "cap", "capsules": "cap",
    "syp": "syrup", "syrup": "syrup", "syr": "syrup", "syp.": "syrup",
    "crm": "cream", "cream": "cream", "cr": "cream", "cr.": "cream", "oint": "ointment", "ointment": "ointment", "gel": "gel",
    "drp": "drops", "drops": "drops", "drop": "drops", "gtt": "drops", "supp": "supp", "suppository": "supp", "infant supp": "infant supp",
    "inj": "injectable", "injection": "injectable", "amp": "injectable", "ampoule": "injectable", "ampoules": "injectable", "amb": "injectable",
    "vial": "injectable", "vials": "injectable", "syringe": "injectable", "syringes": "injectable",
    "sach": "sachet", "sachet": "sachet", "sachets": "sachet", "sach.": "sachet", "sac": "sachet", "sac.": "sachet",
    "susp": "suspension", "suspension": "suspension", "sol": "solution", "soln": "solution", "solution": "solution",
    "eff": "eff", "effervescent": "eff", "inf": "infant", "infant": "infant", "powd": "powder", "powder": "powder",
    "mw": "mouthwash", "mouthwash": "mouthwash", "lin": "liniment", "liniment": "liniment", "bottle": "bottle",
    "mg": "mg", "mcg": "mcg", "ml": "ml", "gm": "gm", "g": "gm", "kg": "kg", "iu": "iu", "cc": "ml",
    "wipe": "wipe", "piece": "piece", "pad": "pad", "gran": "granules", "gran.": "granules",
    "p": "", "pcs": "", "pc": "", "x": "", "percent": "percent", "offer": "offer", "free": "free", "plus": "plus", "extra": "extra", "123": "1 2 3",
}

# Spellings of forms that are one form.
FORM_SYNONYMS = {
    "injection": "injectable", "ampoule": "injectable", "ampoules": "injectable", "ampoul": "injectable", "ampl": "injectable", "aml": "injectable",
    "amp": "injectable", "inj": "injectable", "vial": "injectable", "vials": "injectable", "vail": "injectable", "syringe": "injectable", "syring": "injectable",
    "creamy": "cream", "emulgel": "gel", "sachets": "sachet", "granules": "sachet", "pacets": "sachet", "packets": "sachet", "bags": "sachet",
    "tablet": "tab", "tablets": "tab", "caplet": "tab", "caplets": "tab", "capsule": "cap", "capsules": "cap",
    "suppository": "supp", "suppositories": "supp", "vag": "vaginal", "eff": "effervescent", "efer": "effervescent",
    "penfills": "penfill", "hfa": "inhaler", "botelle": "bottle", "wish": "wash", "beby": "baby", "micro": "mcg",
}

# Arabic letters, digits, number words and stop words.
ARABIC_LETTERS = ("أإآةى", "اااهي")
ARABIC_DIGITS = ("٠١٢٣٤٥٦٧٨٩", "0123456789")
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ]"
NUMBER_WORDS = {
    "وان": "1", "تو": "2", "ثري": "3", "فور": "4", "فايف": "5", "سكس": "6", "سفن": "7", "ايت": "8", "ناين": "9", "تن": "10",
    "واحد": "1", "اثنين": "2", "ثلاثه": "3", "اربعه": "4", "خمسه": "5", "سته": "6", "سبعه": "7", "تمانيه": "8", "تسعه": "9", "عشره": "10",
    "صفر": "0", "نص": "0.5",
}
STOP_WORDS = ("مضاد", "حيوي", "مسكن", "للالام", "خافض", "للحراره", "لعلاج", "للاطفال", "مكمل", "غذائي", "دواء", "علاج", "رقم", "كبير", "صغير", "جدا", "مع", "ثلاجه", "مصري", "طقم", "قطع", "قطعه", "كارت", "كرت")

# Tokens of low weight in scores, and queries that are not matched.
LOW_WEIGHT = (
    "protect", "plus", "slim", "film", "coated", "48h", "72h", "deodorant", "slow", "release", "sustained", "extra", "long", "thick", "soft",
    "gentle", "daily", "care", "advanced", "ultra", "pro", "max", "fragrance", "free", "natural", "active", "total", "original", "cotton", "cottony",
    "breathable", "sensitive", "growth", "nourishing", "caffeine", "anti", "dandruff", "fresh", "cool", "dry", "skin", "essentials", "travel",
    "size", "random", "color", "choice", "value", "pack", "protection", "intensive", "instant", "granules", "in", "topical", "flavor", "mouthwash",
    "toothpaste", "advance", "stage", "prefilled", "fridge", "powder", "oral", "sugar", "delayed", "prolonged", "infantile", "action", "double",
    "paint", "wet", "wipes", "liquid", "syrup", "suspension", "solution", "injectable", "cream", "gel", "ointment", "drops", "spray", "sachet",
    "lotion", "suppository", "supp", "eff", "mg", "mcg", "ml", "gm", "iu", "kg", "for", "and", "with", "the", "of", "to", "a", "an", "antispasmodic",
    "abdominal", "pain", "discomfort", "cramps", "relief", "thrombosis", "prevent", "dizziness", "circulatory", "disorders", "allergies",
    "antibiotic", "infusion", "analgesic", "antipyretic", "antihistamine", "antiinflammatory", "antibacterial", "antifungal", "antiviral",
    "treatment", "therapy", "formula", "professional", "medical", "acute", "chronic", "forte", "sr", "xr", "er", "lp", "od", "ds", "comp", "ha",
    "ec", "fl", "iv", "im", "sc",
)
SKIP = ("razor", "blade", "shaving brush", "makeup brush", "makeup set", "comb", "hair brush", "eyelash", "nail clipper", "scissors", "tweezers", "glass cleaner", "handle", "loofah", "socks")
COMBINATION = ("plus", "co", "comp", "extra")
