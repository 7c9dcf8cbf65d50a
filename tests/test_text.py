import pytest
from pyspark.sql import functions as F

from kinlink.functions import keys as K
from kinlink.functions.grams import char_wb, word_ngrams
from kinlink.functions.text import dominant_script, norm_legal, norm_universal, romanised_word, without_repeats, word_tokens


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_romanise():
    assert " ".join(map(romanised_word, "लक्ष्मी मीडिया".split())) == "lakssmii miiddiyaa"
    assert " ".join(map(romanised_word, "Société Générale".split())).lower() == "societe generale"
    assert romanised_word("Straße") == "Strasse"


def test_normalisers(spark):
    n, a = F.col("n"), F.col("a")
    assert one(spark, norm_universal(n, a), n="Orelee's Barber–Shop", a="1795  Drive") == "orelee s barber–shop 1795 drive"
    assert one(spark, norm_legal(n, a), n="Prime Money Inc.", a="17560 Ellis Rd, Tahlequah") == "prime money 17560 ellis rd tahlequah"
    assert one(spark, norm_legal(n, a, romanised=True), n="Société SA", a=None) == "societe"


def test_char_grams(spark):
    assert one(spark, char_wb(F.col("t"), 3, 4), t="Ab  cde") == [" ab", "ab ", " ab ", " cd", "cde", "de ", " cde", "cde "]
    assert one(spark, char_wb(F.col("t"), 3, 4), t="a") == [" a "]
    assert one(spark, char_wb(F.col("t"), 3, 5), t="a") == [" a "]
    assert one(spark, char_wb(F.col("t"), 3, 4), t="  ") == []


def test_word_grams(spark):
    assert one(spark, word_ngrams(F.col("t")), t="Red x société bolt") == ["red", "société", "bolt", "red société", "société bolt"]
    assert one(spark, word_ngrams(F.col("t")), t="x") == []


@pytest.mark.parametrize(("text", "script"), [("abc 12", "LATIN"), ("मीडिया ab", "DEVANAGARI"), (" ", "EMPTY/UNKNOWN"), ("12, 4", "NUMERIC/PUNCT_ONLY")])
def test_script(spark, text, script):
    assert one(spark, dominant_script(F.col("t")), t=text) == script


def test_tokens(spark):
    assert one(spark, word_tokens(F.col("t")), t="Société Générale 12") == ["société", "générale", "12"]
    assert one(spark, without_repeats(F.split("t", " ")), t="a a b a") == ["a", "b", "a"]


def test_keys(spark):
    for token, code in {"ashcraft": "A261", "tymczak": "T522", "7eleven": ""}.items():
        assert one(spark, K.soundex(F.col("t")), t=token) == code
    assert one(spark, K.pincode(F.col("t")), t="Pune 411001") == "411001"
    assert one(spark, K.pincode(F.col("t")), t="Pune 011001") == ""
    assert one(spark, K.state(F.col("t")), t="Kochi, Kerala 682001") == "KL"
    assert one(spark, K.city(F.col("t")), t="MG Road, Bangalore") == "bengaluru"
    keys = one(spark, K.blocking_keys(F.col("n"), F.col("a")), n="The Acme Tools", a="Pune, Maharashtra 411001")
    assert keys["clean_sig_prefix_2"] == "ac" and keys["raw_prefix_3"] == "the" and keys["comp_sig1_pincircle"] == "a_c41" and keys["comp_sig2_state"] == "ac_MH"
    sets = one(spark, K.disjunctive_keys(K.blocking_keys(F.col("n"), F.col("a"))), n="The Acme Tools", a="Pune 411001")
    assert sets["disj_w1_2_OR_w2_2"] == ["w1_ac", "w2_ac"] and sets["disj_composite_robust"] == ["np_ac_41"]
    assert one(spark, K.coarse_key(F.col("n"), F.col("a"), "name2_city"), n="", a="") == "u_unk"
    with pytest.raises(ValueError, match="Unknown strategy"):
        K.coarse_key(F.col("n"), F.col("a"), "none")
