"""Blocking keys of names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grams import bind
from .text import name_tokens, romanise

# State names and codes in the order in which they are looked up.
STATES = {
    "andhra pradesh": "AP", "andhra": "AP", "ap": "AP", "arunachal pradesh": "AR", "arunachal": "AR", "assam": "AS",
    "bihar": "BR", "chhattisgarh": "CG", "chattisgarh": "CG", "goa": "GA", "gujarat": "GJ", "gujrat": "GJ",
    "haryana": "HR", "himachal pradesh": "HP", "himachal": "HP", "jharkhand": "JH", "karnataka": "KA", "kerala": "KL",
    "madhya pradesh": "MP", "maharashtra": "MH", "manipur": "MN", "meghalaya": "ML", "mizoram": "MZ", "nagaland": "NL",
    "odisha": "OD", "orissa": "OD", "punjab": "PB", "rajasthan": "RJ", "sikkim": "SK", "tamil nadu": "TN",
    "tamilnadu": "TN", "telangana": "TS", "telengana": "TS", "tripura": "TR", "uttar pradesh": "UP",
    "uttarpradesh": "UP", "uttarakhand": "UK", "uttaranchal": "UK", "west bengal": "WB", "bengal": "WB", "delhi": "DL",
    "new delhi": "DL", "chandigarh": "CH", "jammu and kashmir": "JK", "jammu & kashmir": "JK", "jammu": "JK",
    "kashmir": "JK", "ladakh": "LA", "puducherry": "PY", "pondicherry": "PY",
}
# The shorter list that the sub-partition keys use.
STATES_SHORT = {
    "andhra pradesh": "AP", "andhra": "AP", "ap": "AP", "arunachal pradesh": "AR", "assam": "AS", "bihar": "BR",
    "chhattisgarh": "CG", "goa": "GA", "gujarat": "GJ", "gujrat": "GJ", "haryana": "HR", "himachal pradesh": "HP",
    "jharkhand": "JH", "karnataka": "KA", "kerala": "KL", "madhya pradesh": "MP", "maharashtra": "MH", "manipur": "MN",
    "meghalaya": "ML", "mizoram": "MZ", "nagaland": "NL", "odisha": "OD", "orissa": "OD", "punjab": "PB",
    "rajasthan": "RJ", "sikkim": "SK", "tamil nadu": "TN", "tamilnadu": "TN", "telangana": "TS", "telengana": "TS",
    "tg": "TS", "tripura": "TR", "uttar pradesh": "UP", "uttarakhand": "UK", "west bengal": "WB", "delhi": "DL",
    "new delhi": "DL", "chandigarh": "CH",
}
# Large cities.
CITIES = (
    "mumbai", "delhi", "bengaluru", "bangalore", "hyderabad", "ahmedabad", "chennai", "kolkata", "surat", "pune",
    "jaipur", "lucknow", "kanpur", "nagpur", "indore", "thane", "bhopal", "visakhapatnam", "pimpri", "patna",
    "vadodara", "ghaziabad", "ludhiana", "agra", "nashik", "faridabad", "meerut", "rajkot", "varanasi", "srinagar",
    "aurangabad", "dhanbad", "amritsar", "navi mumbai", "allahabad", "prayagraj", "ranchi", "howrah", "coimbatore",
    "jabalpur", "gwalior", "vijayawada", "jodhpur", "madurai", "raipur", "kota", "guwahati", "chandigarh", "solapur",
    "hubli", "dharwad", "bareilly", "moradabad", "mysore", "mysuru", "gurgaon", "gurugram", "aligarh", "jalandhar",
    "tiruchirappalli", "bhubaneswar", "salem", "warangal", "mira bhayandar", "thiruvananthapuram", "bhiwandi",
    "saharanpur", "guntur", "amravati", "bikaner", "noida", "jamshedpur", "bhilai", "cuttack", "firozabad", "kochi",
    "cochin", "bhavnagar", "dehradun", "durgapur", "asansol", "nanded", "kolhapur", "ajmer", "gulbarga", "jamnagar",
    "ujjain", "loni", "siliguri", "jhansi", "ulhasnagar", "jammu", "sangli", "mangalore", "mangaluru", "erode",
    "belgaum", "belagavi", "ambattur", "tirunelveli", "malegaon", "gaya",
)
# Other names of a city.
CITY_SYNONYMS = {
    "bangalore": "bengaluru", "prayagraj": "allahabad", "mysuru": "mysore", "gurugram": "gurgaon",
    "mangaluru": "mangalore", "cochin": "kochi",
}
# Words that say little at the start of a name; the sub-partition keys leave out two of them.
STOPWORDS = (
    "the", "m/s", "ms", "shri", "shree", "sri", "dr", "dr.", "prof", "hotel", "om", "jai", "new", "all", "national",
    "indian", "india", "royal", "golden", "sai",
)
STOPWORDS_SHORT = tuple(w for w in STOPWORDS if w not in ("dr.", "prof"))


def pincode(address: Column) -> Column:
    """The first six-digit code that does not start with 0, or the empty string."""
    return F.regexp_extract(F.coalesce(address, F.lit("")), r"\b([1-9][0-9]{5})\b", 1)


def _first_code(states: dict[str, str], found) -> Column:
    """The code of the first name of the list that is found."""
    return F.coalesce(*(F.when(found(name), code) for name, code in states.items()), F.lit(""))


def state(address: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(address, F.lit(""))), F.lit(r"\b[a-z&]+\b"), F.lit(0))
    spaced = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return bind(spaced, lambda line: _first_code(STATES, lambda name: line.contains(f" {name} ")))


def state_short(address: Column) -> Column:
    return bind(F.lower(romanise(F.coalesce(address, F.lit("")))), _state_short)


def _state_short(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r"\b[a-z&]+\b"), F.lit(0))
    both = F.struct(tokens.alias("tokens"), F.concat(F.lit(" "), text, F.lit(" ")).alias("line"))
    return bind(both, lambda x: _first_code(STATES_SHORT, lambda name: F.array_contains(x["tokens"], name) | x["line"].contains(f" {name} ")))


def city(address: Column) -> Column:
    """A large city's usual name, alphabetically the first if there are several, or the empty string."""
    return bind(F.lower(romanise(F.coalesce(address, F.lit("")))), _city)


def _city(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r"\b[a-z0-9]+\b"), F.lit(0))
    first = F.array_min(F.array_intersect(tokens, F.array(*map(F.lit, CITIES))))
    usual = bind(first, lambda one: F.coalesce(*(F.when(one == a, b) for a, b in CITY_SYNONYMS.items()), one, F.lit("")))
    return F.when(text.contains("navi mumbai"), "mumbai").when(text.contains("new delhi"), "delhi").otherwise(usual)


def significant_token(tokens: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    good = F.filter(tokens, lambda t: ~t.isin(*stopwords) & (F.length(t) >= 2))
    return F.coalesce(F.get(good, 0), F.get(tokens, 0), F.lit(""))


def soundex(token: Column) -> Column:
    return F.when(token.rlike("^[A-Za-z]"), F.soundex(token)).otherwise("")


def prefix(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.substring(text, 1, n)).otherwise("")


def _all(*parts: Column, when: tuple[Column, ...]) -> Column:
    good = F.lit(True)
    for c in when:
        good = good & (c != "")
    return F.when(good, F.concat(*parts)).otherwise("")


def blocking_keys(name: Column, address: Column) -> Column:
    """A map from strategy to key; '' where a key is missing. Names that start with _ only help to build others."""
    raw = F.regexp_replace(F.lower(romanise(F.coalesce(name, F.lit("")))), r"[^a-z0-9]", "")
    tokens = name_tokens(name)
    parts = F.struct(tokens.alias("tokens"), raw.alias("raw"), pincode(address).alias("pin"), state(address).alias("st"))
    return bind(parts, lambda p: bind(significant_token(p["tokens"]), lambda sig: _single_keys(p, sig)))


def _single_keys(parts: Column, sig: Column) -> Column:
    raw, second = parts["raw"], F.coalesce(F.get(parts["tokens"], 1), F.lit(""))
    pin, st, sx = parts["pin"], parts["st"], soundex(sig)
    one, two, three = (prefix(sig, n) for n in (1, 2, 3))
    # The names of the strategies, and below the tags of sets and of coarse keys, which results carry.
    keys = {
        "raw_prefix_1": prefix(raw, 1),
        "raw_prefix_2": prefix(raw, 2),
        "raw_prefix_3": prefix(raw, 3),
        "clean_sig_prefix_1": one,
        "clean_sig_prefix_2": two,
        "clean_sig_prefix_3": three,
        "name_soundex": sx,
        "addr_pincode_6": pin,
        "addr_pincode_circle_2": F.substring(pin, 1, 2),
        "addr_pincode_zone_1": F.substring(pin, 1, 1),
        "addr_state": st,
        "comp_sig1_state": _all(one, F.lit("_"), st, when=(sig, st)),
        "comp_sig2_state": _all(two, F.lit("_"), st, when=(two, st)),
        "comp_sig1_pinzone": _all(one, F.lit("_z"), F.substring(pin, 1, 1), when=(sig, pin)),
        "comp_sig2_pinzone": _all(two, F.lit("_z"), F.substring(pin, 1, 1), when=(two, pin)),
        "comp_sig1_pincircle": _all(one, F.lit("_c"), F.substring(pin, 1, 2), when=(sig, pin)),
        "comp_soundex_state": _all(sx, F.lit("_"), st, when=(sig, st)),
        "_second_sig_prefix_2": prefix(second, 2),
    }
    return F.create_map(*(x for k, v in keys.items() for x in (F.lit(k), v)))


def disjunctive_keys(keys: Column) -> Column:
    """A map from scheme to the set of tagged keys, from the map of blocking_keys()."""
    return bind(keys, _schemes)


def _schemes(keys: Column) -> Column:
    two, three, second = keys["clean_sig_prefix_2"], keys["clean_sig_prefix_3"], keys["_second_sig_prefix_2"]
    pin, st, sx = keys["addr_pincode_circle_2"], keys["addr_state"], keys["name_soundex"]

    def tagged(*options: tuple[str, tuple[Column, ...]]) -> Column:
        out = []
        for tag, parts in options:
            good = F.lit(True)
            for p in parts:
                good = good & (p != "")
            out.append(F.when(good, F.concat_ws("_", F.lit(tag), *parts)))
        return F.array_distinct(F.array_compact(F.array(*out)))

    schemes = {
        "disj_w1_2_OR_w2_2": tagged(("w1", (two,)), ("w2", (second,))),
        "disj_name2_OR_pincircle2": tagged(("nm", (two,)), ("pin", (pin,))),
        "disj_composite_robust": tagged(("ns", (two, st)), ("np", (two, pin)), ("ss", (sx, st))),
        "disj_name2_OR_soundex": tagged(("pref", (two,)), ("sndx", (sx,))),
        "disj_name3_OR_name2state": tagged(("pref3", (three,)), ("p2st", (two, st))),
    }
    return F.create_map(*(x for k, v in schemes.items() for x in (F.lit(k), v)))


def _first_letters(sig: Column, n: int, missing: str) -> Column:
    return F.when(sig == "", missing).otherwise(F.substring(sig, 1, n))


def coarse_key(name: Column, address: Column, strategy: str) -> Column:
    """One key for each record, never empty."""
    sig = significant_token(name_tokens(name), STOPWORDS_SHORT)
    if strategy == "name_pref2":
        return _first_letters(sig, 2, "UNK")
    if strategy == "name_pref3":
        return _first_letters(sig, 3, "UNK")
    if strategy == "city":
        c, s = city(address), state_short(address)
        return F.when(c != "", F.concat(F.lit("c_"), c)).when(s != "", F.concat(F.lit("s_"), s)).otherwise("loc_UNK")
    if strategy == "name1_state":
        s = state_short(address)
        return F.concat_ws("_", _first_letters(sig, 1, "u"), F.when(s != "", s).otherwise("unk"))
    if strategy == "name2_city":
        c, s = city(address), state_short(address)
        return F.concat_ws("_", _first_letters(sig, 2, "u"), F.when(c != "", c).when(s != "", s).otherwise("unk"))
    raise ValueError(f"Unknown strategy: {strategy}")


def multi_keys(name: Column, address: Column, strategy: str) -> Column:
    """A set of keys for each record, never empty; two records meet if they share any."""
    tokens = name_tokens(name)
    sig, second = significant_token(tokens, STOPWORDS_SHORT), F.coalesce(F.get(tokens, 1), F.lit(""))

    def tagged(tag: str, text: Column) -> Column:
        return F.when(F.length(text) >= 2, F.concat(F.lit(tag), F.substring(text, 1, 2)))

    if strategy == "disj_w1_w2":
        found, missing = F.array(tagged("w_", sig), tagged("w_", second)), "w_unk"
    elif strategy == "disj_name2_or_city":
        c = city(address)
        found, missing = F.array(tagged("n_", sig), F.when(c != "", F.concat(F.lit("c_"), c))), "unk"
    else:
        raise ValueError(f"Unknown strategy: {strategy}")
    found = F.array_distinct(F.array_compact(found))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(missing)))
