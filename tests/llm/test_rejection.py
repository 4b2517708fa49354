"""Texts that no learned language explains are rejected, whatever the shares of the languages."""

import random

from pyspark.sql import functions as F

from riskloom.llm import language


def junk(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n))


def test_ties_and_foreign_texts_are_rejected(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language.fit(docs, ~language.held_out("doc_id", 5, 0))
    r = random.Random(3)
    cyrillic, han = "абвгдежзиклмнопрстуфхцчшыьэюя", [chr(x) for x in range(0x4E00, 0x9000)]
    bad = [junk(r, letters, n) for letters in ("bcdfghjklmnpqrstvwxz", cyrillic, han) for n in (3, 50, 400) for _ in range(10)] + ["A.", "Q"]
    got = language.identify(spark.createDataFrame(list(enumerate(bad)), "doc_id long, text string"), learned).collect()
    assert len(got) == len(bad) and not any(x.accepted for x in got)
    assert language.keep_known(spark.createDataFrame([(t,) for t in bad], "text string"), learned).count() == 0
    clean = docs.where(language.held_out("doc_id", 5, 0) & (F.length("text") >= 100))
    assert language.keep_known(clean, learned).count() >= 0.98 * clean.count()


def test_margin_is_fitted_and_whole_texts_are_samples(spark):
    r = random.Random(4)
    langs = {k: junk(r, v, 80).split() for k, v in {"aa": "abcdefgh", "bb": "efghijkl"}.items()}
    rows = [(i, " ".join(r.choice(langs[k]) for _ in range(40 if i % 9 else 900)), k) for i in range(400) for k in [r.choice(list(langs))]]
    rows += [(1000 + i, junk(r, "klmno", 30), "aa") for i in range(60)] + [(2000, "x1", "cc")]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string")
    learned = language.fit(df, ~language.held_out("doc_id", 5, 0))
    assert set(learned) == {"aa", "bb", "cc"} and learned.margin >= language.MARGIN
    got = language.language_id(df).collect()
    assert len(got) == len(df.collect()) and len({(x.doc_id, x.lang_pred, x.score) for x in got}) == len(rows)
    plain = [x for x in got if x.doc_id < 400]
    assert sum(x.lang_pred == rows[x.doc_id][2] for x in plain) > 0.95 * len(plain)
    # the longest whole texts are in the dictionaries, none cut
    assert any(language.plain(t).encode() in learned[k][0] for i, t, k in rows if i < 400 and i % 9 == 0)


def test_sizes_equal_plain_compression():
    import zstandard

    r = random.Random(5)
    learned = {k: (junk(r, v, 400).encode(), 0.5) for k, v in {"aa": "abcdefgh", "bb": "efghijkl"}.items()}
    m = language.Model(learned)
    for n in (1, 30, 2000):
        t = junk(r, "abcdefgh", n)
        want = []
        for k in sorted(learned):
            d = zstandard.ZstdCompressionDict(learned[k][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            want.append(sum(len(c.compress(t[i:i + language.BLOCK].encode())) for i in range(0, len(t), language.BLOCK)))
        near = abs(want[0] - want[1]) < language.NARROW
        assert m.predict(t)[0] == ("aa" if want[0] < want[1] else "bb") or near
        assert near or m.sizes(t) == want
