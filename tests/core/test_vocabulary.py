from pyspark.sql import functions as F

from lineweave.functions import vocabulary as V

INITIAL, VOWEL = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
SOFT = dict(zip("ㄲㄸㅃㅆㅉ", "ㄱㄷㅂㅅㅈ")) | dict(zip("ㅑㅒㅕㅖㅛㅠ", "ㅏㅐㅓㅔㅗㅜ"))


def plain(syllable, vocabulary):
    code = ord(syllable) - 0xAC00
    a, b, c = INITIAL[code // 588], VOWEL[code // 28 % 21], code % 28
    for x in (a, SOFT.get(a, a)):
        for y in (b, SOFT.get(b, b)):
            for z in (c, 0):
                s = chr(0xAC00 + INITIAL.index(x) * 588 + VOWEL.index(y) * 28 + z)
                if s != syllable and s in vocabulary:
                    return s
    return None


def test_every_syllable(spark):
    df = spark.range(0xAC00, 0xAC00 + 11172).select(V.letter(F.col("id")).alias("c"))
    for vocabulary in (V.SMALL, "아봉압가"):
        got = {r.c: r.v for r in df.select("c", V.in_vocabulary(F.col("c"), vocabulary).alias("v")).collect()}
        assert len(got) == 11172
        assert got == {c: c if c in vocabulary else plain(c, vocabulary) for c in got}


def test_other_letters(spark):
    rows = [("A", "a"), ("a", "a"), ("é", None), ("", None), (None, None), ("ab", None), ("뿅", "봉"), ("㉠", None), ("😀", None)]
    df = spark.createDataFrame(rows, "c string, want string")
    assert [r.v for r in df.select(V.in_vocabulary(F.col("c"), "abc봉")).toDF("v").collect()] == [w for _, w in rows]
    assert [list(r.s) for r in df.select(V.substitutes(F.col("c"))).toDF("s").collect()][:3] == [[], [], []]
    assert df.where("c = '뿅'").select(V.substitutes(F.col("c"))).first()[0] == ["뾰", "뽕", "뽀", "뵹", "뵤", "봉", "보"]
