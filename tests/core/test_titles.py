from lineweave.operators import titles as T


def test_two_passes_and_guards(spark):
    songs = [(1, "Melt", None, "melt"), (2, "Cinderella", "x/ZIG", "cinderella"), (3, "Cinderella", "y/DECO27", "cinderella-2"), (4, "Dec.", None, "dec"), (5, "Night Sky Song", None, "n"), (6, "Miku", None, "m"), (7, None, None, None)]
    titles = ["Melt - ryo", "Cinderella - DECO27", "Cinderella - nobody", "DECO27", "Night Sky Songs (MV)", "Night Sky Song feat. Miku", "Other Thing - Miku", "zzz", None, "!!", "Melt - ryo"]
    got = T.look_up(spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame(songs, "entry long, name string, alias string, slug string"), ("miku",))
    assert {r.title: (r.entry, r.exact) for r in got.collect()} == {
        "Melt - ryo": (1, True),
        "Cinderella - DECO27": (3, True),
        "Cinderella - nobody": (2, True),
        "DECO27": (3, False),
        "Night Sky Songs (MV)": (5, False),
        "Night Sky Song feat. Miku": (5, True),
    }
    assert got.count() == 6


def test_held_keys_of_two_letters(spark):
    a, b = spark.createDataFrame([("ab",), ("xabx",), ("abcdef",)], "a string"), spark.createDataFrame([("abc",), ("ab",), ("f",)], "b string")
    assert sorted(tuple(r) for r in T.held_keys(a, b).collect()) == [("ab", "ab"), ("ab", "abc"), ("abcdef", "abc"), ("xabx", "ab")]
