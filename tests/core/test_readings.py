"""Readings of hand-made words."""

from pyspark.sql import functions as F

from lineweave.functions import readings as R


def read(spark, f, words):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r.x for r in rows.select("i", f(F.col("w")).alias("x")).orderBy("i").collect()]


def test_kana_in_latin_letters(spark):
    words = ["ずっと", "まっちゃ", "しんよう", "てんき", "スーパー", "きょうは", "a, b", "", None, "っ", "ーあ", "コーヒーー"]
    assert read(spark, R.kana_latin, words) == ["zutto", "matcha", "shin'you", "tenki", "suupaa", "kyouha", "a, b", "", None, "", "a", "koohiii"]


def test_kana_in_hangul(spark):
    words = ["ずっと", "じぶんが", "スーパー", "んあ", "っあ", "じゃ", "しゃ", "ちゅ", "かっん", "x ん", "", None]
    assert read(spark, R.kana_hangul, words) == ["즛토", "지분가", "스우파아", "응아", "아", "자", "샤", "추", "캇응", "x 응", "", None]


def test_hangul_in_latin_letters(spark):
    words = ["흘러", "신라", "있어", "많아", "좋아", "닭", "한국 음악", "강아지", "abc", "", None]
    assert read(spark, R.hangul_latin, words) == ["heulleo", "silla", "isseo", "mana", "joa", "dak", "hanguk eumak", "gangaji", "abc", "", None]


def test_numbers(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 10, 300, 8600, 10000, 210_003_000, 10**16, -1, None)], "n long")
    got = [r[0] for r in rows.select(R.number_reading(F.col("n"))).collect()]
    assert got == ["ゼロ", "いち", "じゅう", "さんびゃく", "はっせんろっぴゃく", "いちまん", "におくせんまんさんぜん", None, None, None]
