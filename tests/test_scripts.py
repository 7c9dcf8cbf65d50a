import unicodedata

import pytest
from pyspark.sql import functions as F

from kinlink.functions.scripts import fold_table, folded, plain, romanised, romanised_word
from kinlink.functions.text import name_tokens, norm_legal, romanise


@pytest.mark.parametrize(
    ("word", "spelling"),
    [
        # inherent vowel, conjuncts, anusvara before each kind of letter, candrabindu, visarga, nukta, signs
        ("लक्ष्मी", "lakssmii"), ("मीडिया", "miiddiyaa"), ("हिंदी", "hindii"), ("संस्था", "sansthaa"), ("कंपनी", "kampanii"), ("चाँद", "caanda"), ("दुःख", "duhkha"),
        ("फ़ैक्टरी", "faikttarii"), ("सड़क", "saraka"), ("बाज़ार", "baazaara"), ("क़लम", "qalama"), ("ॐ", "om"), ("१२", "12"), ("क्‍ष", "kssa"),
        ("বাংলা", "baanglaa"), ("কোম্পানি", "kompaani"), ("ਪੰਜਾਬ", "panjaaba"), ("ਪੱਕਾ", "pakkaa"), ("ગુજરાત", "gujaraata"), ("ଓଡ଼ିଶା", "orishaa"),
        ("தமிழ்", "tamilll"), ("తెలుగు", "telugu"), ("విజయం", "vijayam"), ("ಕರ್ನಾಟಕ", "karnaattaka"), ("മലയാളം", "malayaallam"), ("എൻ", "en"), ("ශ්‍රී", "shrii"), ("ලංකාව", "langkaava"),
        # vowels before their consonants, a silenced letter
        ("ไทย", "thaiy"), ("กรุงเทพ", "krungtheph"), ("ประเทศ", "prathes"), ("สิทธิ์", "sith"), ("ລາວ", "laaw"),
        # alphabets
        ("שלום", "shlvm"), ("שׂרה", "srh"), ("ירושלים", "yrvshlym"), ("شركة", "shrkh"), ("پاکستان", "pakstan"), ("مُحَمَّد", "muhammad"), ("Щука", "Shchuka"), ("Љубљана", "Ljubljana"),
        ("Ουρανός", "Ouranos"), ("საქართველო", "sakartvelo"), ("Հայաստան", "Hayastan"), ("Þór", "THor"), ("ıldız", "ildiz"), ("Ŋaam", "NGaam"), ("Ærø", "AEro"), ("Straße", "Strasse"),
        ("とうきょう", "toukyou"), ("がっこう", "gakkou"), ("コーヒー", "koohii"), ("ファン", "fan"), ("서울", "seoul"),
    ],
)
def test_spelling_by_words(word, spelling):
    assert romanised_word(word) == spelling == romanised_word(unicodedata.normalize("NFD", word))


@pytest.mark.parametrize(
    ("text", "spelling"),
    [("Straße", "Strasse"), ("Łódź", "Lodz"), ("Москва", "Moskva"), ("Ελλάδα", "Ellada"), ("हिंदी", "himdii"), ("“Ærø” – 5€", '"AEro" - 5€'), ("שלום", "shlvm"), ("東京", "東京"), ("é", "e")],
)
def test_spelling_by_code_points(text, spelling):
    assert folded(text) == spelling


SCRIPTS = {"DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "THAI", "LAO"}


def test_every_letter_of_the_scripts_is_spelt():
    modern = [*range(0x400, 0x460), *range(0x531, 0x557), *range(0x561, 0x588), *range(0x5D0, 0x5EB), *range(0x620, 0x64B), *range(0x10D0, 0x10F1), *range(0x3041, 0x3097), *range(0x30A1, 0x30FB), *range(0xC0, 0x180)]
    modern += [p for p in range(0x370, 0x400) if unicodedata.name(chr(p), "").startswith(("GREEK SMALL LETTER ALPHA", "GREEK SMALL LETTER OMEGA")) or 0x391 <= p <= 0x3CE and p != 0x3A2]
    own = [p for p in range(0x900, 0xF00) if unicodedata.name(chr(p), "").split(" ")[0] in SCRIPTS and unicodedata.category(chr(p)) in ("Lo", "Mn", "Mc", "Nd")]
    assert len(own) > 900
    for p in [p for p in modern if chr(p).isalpha()] + own:
        assert romanised_word(chr(p)).isascii() and plain(chr(p)).isascii(), unicodedata.name(chr(p))
    assert all(k not in ("", "a") and t.isascii() for k, t in fold_table().items())


def test_columns(spark):
    rows = [("Straße 5 Łódź Ltd", "Москва, हिंदी"), ("plain Inc", None), (None, None)]
    df = spark.createDataFrame(rows, "n string, a string").select(
        norm_legal(F.col("n"), F.col("a")).alias("folded"), norm_legal(F.col("n"), F.col("a"), romanised=True).alias("spelt"), romanise(F.col("n")).alias("n"), name_tokens(F.col("a")).alias("t")
    )
    assert [tuple(r) for r in df.collect()] == [
        ("strasse 5 lodz moskva himdii", "strasse 5 lodz moskva hindii", "Strasse 5 Lodz Ltd", ["moskva", "hindii"]), ("plain", "plain", "plain Inc", []), ("", "", None, []),
    ]
    assert romanised("संस्था  ltd") == "sansthaa ltd"
