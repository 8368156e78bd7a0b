"""The Porter2 (Snowball English) stemmer as Column expressions.

After the published description of the algorithm. Every step is a ``transform`` over the tokens of a
text, so stemming is a projection: it needs no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.functions.text import words

# Fixed values of the algorithm.
VOWEL = "[aeiouy]"
OTHER = "[^aeiouy]"
DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
SHORT_SYLLABLE = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
LI_ENDING = "[cdeghkmnrt]li$"
R1_PREFIXES = "^(gener|commun|arsen)"
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = "^(inning|outing|canning|herring|earring|proceed|exceed|succeed)$"
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
ADJECTIVAL = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
DROPPED = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize", "ion",
)


def _ending(word: Column, endings) -> Column:
    """The longest of the endings that the word has, or the empty string."""
    return F.regexp_extract(word, f"({'|'.join(endings)})$", 1)


def _without(word: Column, ending: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(ending))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _state(word: Column, r1: Column, r2: Column, done: Column) -> Column:
    return F.struct(word.alias("w"), r1.alias("r1"), r2.alias("r2"), done.alias("done"))


def _mark(token: Column) -> Column:
    """Unify apostrophes, drop a leading one, write a consonantal y as Y."""
    word = F.regexp_replace(F.translate(token, "’‘‛", "'''"), "^'", "")
    word = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")
    return F.struct(token.alias("t"), word.alias("w"))


def _region_start(text: Column) -> Column:
    """Characters up to and with the first non-vowel after a vowel; all of them if there is none."""
    head = F.length(F.regexp_extract(text, f"^.*?{VOWEL}{OTHER}", 0))
    return F.when(head > 0, head).otherwise(F.length(text))


def _regions(s: Column) -> Column:
    special = F.length(F.regexp_extract(s["w"], R1_PREFIXES, 0))
    r1 = F.when(special > 0, special).otherwise(_region_start(s["w"]))
    return F.struct(s["t"].alias("t"), s["w"].alias("w"), r1.alias("r1"))


def _begin(s: Column) -> Column:
    """Add the second region; settle the words that are not stemmed by rule."""
    fixed = F.element_at(_lookup(SPECIAL), s["t"])
    short = F.length(s["t"]) <= 2
    word = F.when(short, s["t"]).otherwise(F.coalesce(fixed, s["w"]))
    r2 = s["r1"] + _region_start(F.substr(s["w"], s["r1"] + 1))
    return _state(word, s["r1"], r2, short | fixed.isNotNull())


def _possessive(s: Column) -> Column:
    return F.regexp_replace(s["w"], "('s'|'s|')$", "")


def _plural(s: Column) -> Column:
    w = s["w"]
    return (
        F.when(w.endswith("sses"), F.regexp_replace(w, "sses$", "ss"))
        .when(
            w.rlike("(ied|ies)$"),
            F.when(F.length(w) > 4, F.regexp_replace(w, "..$", "")).otherwise(
                F.regexp_replace(w, ".$", "")
            ),
        )
        .when(w.rlike("(us|ss)$"), w)
        .when(w.rlike(f"{VOWEL}.+s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def _past(s: Column) -> Column:
    """Struct of the ending of step 1b and the word without it, where the step applies."""
    ending = _ending(s["w"], ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    return F.struct(s.alias("s"), ending.alias("e"), _without(s["w"], ending).alias("stem"))


def _past_done(p: Column) -> Column:
    s, e, stem = p["s"], p["e"], p["stem"]
    repaired = (
        F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(DOUBLE), F.regexp_replace(stem, ".$", ""))
        .when(
            (F.length(stem) <= s["r1"]) & stem.rlike(SHORT_SYLLABLE), F.concat(stem, F.lit("e"))
        )
        .otherwise(stem)
    )
    eed = e.isin("eed", "eedly")
    return (
        F.when(e == "", s["w"])
        .when(eed & (F.length(stem) >= s["r1"]), F.concat(stem, F.lit("ee")))
        .when(~eed & stem.rlike(VOWEL), repaired)
        .otherwise(s["w"])
    )


def _final_y(s: Column) -> Column:
    return F.regexp_replace(s["w"], f"(?<=.{OTHER})[yY]$", "i")


def _derived(s: Column) -> Column:
    w = s["w"]
    ending = _ending(w, DERIVED)
    allowed = (
        (ending != "")
        & (F.length(w) - F.length(ending) >= s["r1"])
        & ((ending != "ogi") | w.endswith("logi"))
        & ((ending != "li") | w.rlike(LI_ENDING))
    )
    swapped = F.concat(_without(w, ending), F.element_at(_lookup(DERIVED), ending))
    return F.when(allowed, swapped).otherwise(w)


def _adjectival(s: Column) -> Column:
    w = s["w"]
    ending = _ending(w, ADJECTIVAL)
    rest = F.length(w) - F.length(ending)
    allowed = (ending != "") & (rest >= s["r1"]) & ((ending != "ative") | (rest >= s["r2"]))
    swapped = F.concat(_without(w, ending), F.element_at(_lookup(ADJECTIVAL), ending))
    return F.when(allowed, swapped).otherwise(w)


def _dropped(s: Column) -> Column:
    w = s["w"]
    ending = _ending(w, DROPPED)
    allowed = (
        (ending != "")
        & (F.length(w) - F.length(ending) >= s["r2"])
        & ((ending != "ion") | w.rlike("[st]ion$"))
    )
    return F.when(allowed, _without(w, ending)).otherwise(w)


def _final_e_or_l(s: Column) -> Column:
    w = s["w"]
    rest = F.length(w) - 1
    stem = F.substring(w, F.lit(1), rest)
    drop_e = w.endswith("e") & (
        (rest >= s["r2"]) | ((rest >= s["r1"]) & ~stem.rlike(SHORT_SYLLABLE))
    )
    drop_l = w.endswith("ll") & (rest >= s["r2"])
    return F.when(drop_e | drop_l, stem).otherwise(w)


def _apply(states: Column, change, also_done=None) -> Column:
    """Change the word of every state that is not done."""

    def step(s: Column) -> Column:
        word = F.when(s["done"], s["w"]).otherwise(change(s))
        done = s["done"] if also_done is None else s["done"] | also_done(s)
        return _state(word, s["r1"], s["r2"], done)

    return F.transform(states, step)


def stem_tokens(tokens: Column) -> Column:
    """The stem of every token of an array, in order."""
    states = F.transform(F.transform(F.transform(tokens, _mark), _regions), _begin)
    states = _apply(states, _possessive)
    states = _apply(states, _plural)
    states = _apply(states, lambda s: s["w"], also_done=lambda s: s["w"].rlike(KEPT_AFTER_PLURAL))
    past = F.transform(states, _past)
    states = F.transform(
        past,
        lambda p: _state(
            F.when(p["s"]["done"], p["s"]["w"]).otherwise(_past_done(p)),
            p["s"]["r1"],
            p["s"]["r2"],
            p["s"]["done"],
        ),
    )
    for change in (_final_y, _derived, _adjectival, _dropped, _final_e_or_l):
        states = _apply(states, change)
    return F.transform(states, lambda s: F.translate(s["w"], "Y", "y"))


def stem_words(text: Column) -> Column:
    """Lower-case and stem every whitespace-separated token; tokens are joined by one space."""
    return F.array_join(stem_tokens(words(F.lower(text))), " ")
