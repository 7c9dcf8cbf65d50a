"""Latin spellings of other scripts, by rules over the Unicode names of letters and tables of alphabets.

romanised_word() reads a word from left to right with a state, as a writing system has it: an Indic or Sinhala consonant carries
an a until a vowel sign or a virama takes it away, a nukta changes the consonant before it, an anusvara sounds as the letter after
it, an addak doubles it; a Thai or Lao vowel written before its consonant is spelt after it; a small kana joins the one before.
plain() spells one code point on its own, for folding to ASCII. Scripts: Latin, Cyrillic, Greek, Armenian, Georgian, Hebrew,
Arabic, the nine Indic blocks from Devanagari to Malayalam, Sinhala, Thai, Lao, kana and Hangul. What has no rule stays, such as
Han characters, whose readings no rule gives.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Alphabets and their Latin spellings; - stands for no letter.
_ALPHABETS = (
    ("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґў", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya i yi ye g u"),
    ("ѓќѕјљњћђџәғқңөұүһѣѳѵѫѧӏҥҫҙҡҗҹҳҷ", "gj kj dz j lj nj c dj dz a gh q ng o u u h e f i a e - ng s z q zh ch h j"),
    ("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o"),
    ("ابتثجحخدذرزسشصضطظعغفقكلمنهويةىءأإآؤئپچژگ", "a b t th j h kh d dh r z s sh s d t z a gh f q k l m n h w y h a - a i a w y p ch zh g"),
    ("ؠٹڈڑںھہۂۃکیےۓۀډړښږڼېځڅټګڭۆۇۈۋەڤڕڵێڪٻڀٿڄڃڇڏڌڍڦڱڳڻ", "y t d r n h h h t k y e e h d r sh zh n e dz ts t g ng o u u v e v r l e k b bh th j ny ch d dh dd ph ng g n"),
    ("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "a b g d h v z h t y k k l m m n n s e p p ts ts q r sh t"),
    ("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "a b g d e v z t i k l m n o p zh r s t u p k gh q sh ch ts dz ts ch kh j h"),
    ("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆև", "a b g d e z e y t zh i l kh ts k h dz gh ch m y n sh o ch p j r s v t r ts v p k o f ev"),
)
_SPELT = {letter: "" if plain == "-" else plain for letters, spelling in _ALPHABETS for letter, plain in zip(letters, spelling.split(), strict=True)}

# Signs of Arabic and Hebrew by their names.
_POINTS = {
    "ARABIC FATHA": "a", "ARABIC DAMMA": "u", "ARABIC KASRA": "i", "ARABIC FATHATAN": "an", "ARABIC DAMMATAN": "un", "ARABIC KASRATAN": "in",
    "HEBREW POINT PATAH": "a", "HEBREW POINT HATAF PATAH": "a", "HEBREW POINT QAMATS": "a", "HEBREW POINT HATAF QAMATS": "o",
    "HEBREW POINT SEGOL": "e", "HEBREW POINT HATAF SEGOL": "e", "HEBREW POINT TSERE": "e", "HEBREW POINT HIRIQ": "i", "HEBREW POINT HOLAM": "o", "HEBREW POINT QUBUTS": "u",
}

# Latin letters that decomposition leaves as they are, by their names; of others the name has the letter.
_LATIN = {
    "SHARP S": "ss", "LONG S": "s", "DOTLESS I": "i", "DOTLESS J": "j", "THORN": "th", "ETH": "d", "ENG": "ng", "KRA": "q", "SCHWA": "e",
    "OPEN O": "o", "OPEN E": "e", "REVERSED E": "e", "TURNED E": "e", "EZH": "zh", "ESH": "sh", "YOGH": "y", "WYNN": "w", "GAMMA": "gh", "IOTA": "i",
    "UPSILON": "u", "ALPHA": "a", "HWAIR": "hw", "INSULAR D": "d", "INSULAR F": "f", "INSULAR G": "g", "AFRICAN D": "d",
}
# Signs of print, for folding.
_PRINT = dict(zip("‘’‚‛“”„‟‐‑‒–—―−…«»‹›·•′″¡¿©®°", "' ' ' ' \" \" \" \" - - - - - - - ... << >> < > . * ' \" ! ? (c) (r) deg".split(), strict=True))

_INDIC = {"DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM"}
_VOWELS = {"A", "AA", "I", "II", "U", "UU", "E", "EE", "AI", "O", "OO", "AU", "AW", "OE", "OOE", "UE", "UUE", "R", "RR", "L", "LL"}
#: What a nukta makes of a consonant.
_NUKTA = {"k": "q", "g": "gh", "j": "z", "dd": "r", "ddh": "rh", "ph": "f", "s": "sh", "ll": "l", "nn": "n", "b": "v"}
# Sinhala, whose names do not tell the sounds: consonants, vowels and vowel signs.
_SINHALA = {
    **{c: ("C", s) for c, s in zip("කඛගඝඞඟචඡජඣඤඥඦටඨඩඪණඬතථදධනඳපඵබභමඹයරලවශෂසහළෆ", "k kh g gh ng ng c ch j jh ny gn nj tt tth dd ddh nn ndd t th d dh n nd p ph b bh m mb y r l v sh ss s h ll f".split(), strict=True)},
    **{c: ("V", s) for c, s in zip("අආඇඈඉඊඋඌඍඎඏඐඑඒඓඔඕඖ", "a aa ae aae i ii u uu r rr l ll e ee ai o oo au".split(), strict=True)},
    **{chr(c): ("S", s) for c, s in zip((0xDCF, 0xDD0, 0xDD1, 0xDD2, 0xDD3, 0xDD4, 0xDD6, 0xDD8, 0xDD9, 0xDDA, 0xDDB, 0xDDC, 0xDDD, 0xDDE, 0xDDF, 0xDF2, 0xDF3), "aa ae aae i ii u uu r e ee ai o oo au l rr ll".split(), strict=True)},
    "්": ("H", ""), "ං": ("N", "ng"), "ඃ": ("T", "h"), "ඁ": ("N", "n"),
}
#: Languages whose anusvara ends a word as m, and whose anusvara is ng.
_M_LAST, _NG = {"TELUGU", "KANNADA", "MALAYALAM", "ORIYA"}, {"BENGALI"}
_THAI_VOWELS = {"AI MAIMUAN": "ai", "AI MAIMALAI": "ai", "AM": "am", "UEE": "ue"}
_THAI_FIRST = set("เแโใไເແໂໃໄ")
_KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}


def _alphabetic(ch: str) -> str | None:
    """A letter of an alphabet with a table, its accents dropped; a capital gives a capital."""
    for low in (ch.lower(), unicodedata.normalize("NFD", ch.lower())[0]):
        if (found := _SPELT.get(low)) is not None:
            return found.capitalize() if ch != ch.lower() else found
    return None


def _base(name: str) -> str | None:
    """The spelling of a letter with a further stroke, or of an older form of the alphabet, by that of the letter it is named
    after; a capital gives a capital."""
    letter = name.partition(" WITH ")[0]
    for small in (letter, letter.replace(" CAPITAL ", " SMALL "), letter.replace(" CAPITAL ", " ").replace(" SMALL ", " ")):
        try:
            found = _SPELT.get(unicodedata.lookup(small))
        except KeyError:
            continue
        if found is not None:
            return found.capitalize() if " CAPITAL " in letter else found
    return None


def _indic(script: str, rest: str) -> tuple[str, str]:
    """What an Indic character is (consonant C, dead consonant D, vowel V, vowel sign S, virama H, nasal N, nukta K, addak G, or
    other text T) and its spelling."""
    kind, _, last = rest.rpartition(" ")
    if "VIRAMA" in rest:
        return "H", ""
    if rest.startswith("VOWEL SIGN "):
        return "S", last.lower() if last in _VOWELS else ""
    if rest.startswith(("SIGN ANUSVARA", "SIGN BINDI", "TIPPI", "SIGN COMBINING ANUSVARA")):
        return "N", "ng" if script in _NG else ""
    if "CANDRABINDU" in rest or rest == "SIGN ADAK BINDI":
        return "N", "n"
    if rest == "ADDAK":
        return "G", ""
    if rest == "SIGN NUKTA":
        return "K", ""
    if rest.startswith("SIGN VISARGA"):
        return "T", "h"
    if rest.startswith("LETTER CHILLU ") or rest == "LETTER KHANDA TA":
        return "D", {"RR": "r", "LLL": "zh"}.get(last, last.lower().removesuffix("a"))
    if rest.startswith("LETTER "):
        first = rest.split()[1]
        name = last if first in ("VOCALIC", "CANDRA", "SHORT") else first
        if name in _VOWELS:
            return "V", name.lower()
        if name.endswith("A") and len(name) > 1:
            return "C", name[:-1].lower()
        return "T", name.lower()
    if rest in ("OM", "EK ONKAR"):
        return "T", rest.replace(" ", "").lower()
    if rest in ("DANDA", "DOUBLE DANDA", "ABBREVIATION SIGN"):
        return "T", "."
    return ("V", "") if rest in ("IRI", "URA") else ("T", "")


def _thai(script: str, rest: str) -> tuple[str, str]:
    """As _indic(): consonant C, vowel V, silencing sign H, or other text T."""
    if rest.startswith(("SARA ", "VOWEL SIGN ")):
        name = rest.removeprefix("SARA ").removeprefix("VOWEL SIGN ")
        return "V", _THAI_VOWELS.get(name, name.split()[0].lower())
    if rest == "MAI HAN-AKAT" or rest == "VOWEL SIGN MAI KAN":
        return "V", "a"
    if rest == "THANTHAKHAT" or rest == "CANCELLATION MARK":
        return "H", ""
    if rest in ("NIKHAHIT", "NIGGAHITA"):
        return "T", "m"
    name = rest.removeprefix("LETTER ").split()
    if rest in ("RU", "LU"):
        return "C", rest[0].lower() + "ue"
    if rest == "O ANG" or rest == "LETTER O":
        return "C", "o"
    if script == "LAO" and rest in ("HO NO", "HO MO"):
        return "C", "h" + rest[3].lower()
    if rest.startswith("SEMIVOWEL SIGN "):
        return "C", rest.split()[-1].lower().removesuffix("o")
    if len(name[0]) > 1 and name[0].endswith("O") and (script == "THAI" or rest.startswith("LETTER ")):
        return "C", name[0][:-1].lower()
    return "T", ""


def _unit(ch: str) -> tuple[str, str, str] | None:
    """Script, kind and spelling of a character of a script that is read with a state."""
    if ch in _SINHALA:
        return "SINHALA", *_SINHALA[ch]
    if unicodedata.digit(ch, None) is not None:
        return None
    script, _, rest = unicodedata.name(ch, "").partition(" ")
    if script in _INDIC:
        return script, *_indic(script, rest)
    if script in ("THAI", "LAO"):
        return script, *_thai(script, rest.removeprefix("CHARACTER "))
    if script in ("HIRAGANA", "KATAKANA") and rest.startswith("LETTER "):
        name = rest.split()[-1].lower()
        return "KANA", "small" if rest.startswith("LETTER SMALL ") else "T", _KANA.get(name, name)
    if ch == "ー":
        return "KANA", "long", ""
    return None


def _other(ch: str) -> str:
    """A character outside the scripts that are read with a state; one without a rule stays."""
    if ch.isascii():
        return ch
    if ch in "ʹʻʼʽʾʿˈ":  # modifier letters
        return "'"
    if (found := _alphabetic(ch)) is not None:
        return found
    name = unicodedata.name(ch, "")
    if (found := _POINTS.get(name)) is not None:
        return found
    if unicodedata.category(ch).startswith(("M", "Cf")) or name == "ARABIC TATWEEL":
        return ""
    if name.startswith("HANGUL SYLLABLE "):
        return name.rpartition(" ")[2].lower()
    if (digit := unicodedata.digit(ch, None)) is not None:
        return str(digit)
    fold = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    if name.startswith("LATIN ") and not fold.isascii():
        size, _, letter = name.removeprefix("LATIN ").partition(" LETTER ")
        letter = letter.partition(" WITH ")[0]
        plain = _LATIN.get(letter) or (letter.split() or [""])[-1].lower()
        if letter in _LATIN or len(plain) <= 2:
            return plain.upper() if size.startswith("CAPITAL") else plain
    if not fold.isascii() and (found := _base(name)) is not None:
        return found
    return fold if fold in ("", ch) or fold.isascii() else "".join(map(_other, fold))


class _Speller:
    """The spelling of a word so far, and what the next letter has to know."""

    def __init__(self):
        self.out: list[str] = []
        self.inherent = False  # whether the last piece is a consonant that still carries its a
        self.nasal = ""  # the script of an anusvara that waits for the letter after it
        self.double = False
        self.first = ""  # a vowel written before its consonant
        self.vowel = False  # whether the last piece is a Thai vowel sign
        self.greek = self.point = False

    def settle(self, following: str) -> None:
        """Spells what has waited for the letter that follows (empty: the word ends)."""
        if self.nasal:
            labial = following[:1] in ("p", "b", "m", "f")
            self.out.append("m" if labial or not following and self.nasal in _M_LAST else "n")
            self.nasal = ""

    def close(self) -> None:
        if self.inherent:
            self.out.append("a")
        self.inherent = False

    def indic(self, script: str, kind: str, text: str) -> None:
        if kind == "K":
            if self.inherent:
                self.out[-1] = _NUKTA.get(self.out[-1], self.out[-1])
            return
        if kind == "H":
            self.inherent = False
            return
        if kind == "S":
            self.inherent = False
            self.out.append(text)
            return
        self.close()
        if kind == "N":
            if text:
                self.out.append(text)
            else:
                self.nasal = script
            return
        if kind == "G":
            self.double = True
            return
        self.settle(text)
        self.out.append(text[:1] + text if self.double and kind == "C" else text)
        self.double, self.inherent = False, kind == "C"

    def thai(self, ch: str, kind: str, text: str) -> None:
        if kind == "V" and ch in _THAI_FIRST:
            self.first += text
        elif kind == "H":  # the consonant before is not read, nor its vowel
            del self.out[-2 if self.vowel else -1 :]
            self.vowel = False
        else:
            self.out.append(text)
            self.vowel = kind == "V"
            if kind == "C" and self.first:
                self.out.append(self.first)
                self.first = ""

    def kana(self, kind: str, text: str) -> None:
        before = self.out[-1] if self.out else ""
        if kind == "long":
            self.out.append(before[-1:])
        elif kind == "small" and text == "tsu":
            self.double = True
        elif kind == "small" and before[-1:] in ("i", "u", "e", "o") and len(before) > 1:
            stem = before[:-1]
            self.out[-1] = stem + (text[1:] if text[0] == "y" and stem in ("sh", "ch", "j") else text)
        else:
            self.out.append((text[0] if self.double and text else "") + text)
            self.double = False

    def add(self, ch: str) -> None:
        if unicodedata.category(ch) == "Cf":  # joiners
            return
        unit = _unit(ch)
        if unit and unit[0] == "KANA":
            self.kana(unit[1], unit[2])
        elif unit and unit[0] in ("THAI", "LAO"):
            self.thai(ch, unit[1], unit[2])
        elif unit:
            self.indic(*unit)
        else:
            self.close()
            name = unicodedata.name(ch, "")
            if name == "ARABIC SHADDA" and self.out:  # which normal form puts after the vowel
                self.out.insert(-1 if self.point else len(self.out), self.out[-2 if self.point and len(self.out) > 1 else -1])
            elif name == "HEBREW POINT SIN DOT" and self.out:
                self.out[-1] = "s"
            elif ch in "υύ" and self.out and self.out[-1].lower() == "o" and self.greek:
                self.out.append("u")
            else:
                text = _other(ch)
                self.settle(text)
                self.out.append(text)
            self.point = name in _POINTS
        self.greek = unicodedata.name(ch, "").startswith("GREEK")

    def text(self) -> str:
        self.close()
        self.settle("")
        return "".join(self.out) + self.first


@lru_cache(maxsize=1 << 17)
def romanised_word(word: str) -> str:
    """Latin spelling of a word; a worker keeps the words it has seen."""
    speller = _Speller()
    for ch in unicodedata.normalize("NFC", word):
        speller.add(ch)
    return speller.text()


def romanised(text: str) -> str:
    """Every word that is not ASCII in Latin letters, words joined by a blank."""
    return " ".join(w if w.isascii() else romanised_word(w) for w in text.split())


def plain(ch: str) -> str:
    """One code point in ASCII, whatever stands beside it; one without a rule stays."""
    if ch.isascii():
        return ch
    if ch in _PRINT:
        return _PRINT[ch]
    if ch.isspace():
        return " "
    unit = _unit(ch)
    if unit is None:
        return _other(ch)
    script, kind, text = unit
    return (text or "m") if kind == "N" else text


class _Folds(dict):
    """The table of plain() for str.translate, filled as code points occur."""

    def __missing__(self, point: int) -> str:
        self[point] = plain(chr(point))
        return self[point]


_FOLDS = _Folds()


def folded(text: str) -> str:
    return text.translate(_FOLDS)


def fold_table() -> dict[str, str]:
    """The characters below U+3100 that plain() changes, with what it makes of them: the table as data, for other engines."""
    return {chr(p): t for p in range(0x80, 0x3100) if (t := plain(chr(p))) != chr(p) and t.isascii()}


def latin_table() -> dict[str, str]:
    """The Latin letters and the signs below U+2000 that romanised_word() changes, which it spells one by one."""
    return {chr(p): t for p in (*range(0x80, 0x250), *range(0x1E00, 0x1F00)) if (t := _other(chr(p))) != chr(p)}
