"""The training sample when texts have many copies."""

from tallyline.llm.language_id import sample, train
from tallyline.llm.queries import vocabulary


def test_copies_do_not_crowd_out_texts(spark):
    few = [("aa", f"la casa del re {'x' * i}") for i in range(5)] * 600
    hot = [("bb", "the same text again")] * 3000 + [("bb", f"text number {i}") for i in range(50)]
    rows = few + hot + [("cc", None), (None, "text")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(r) for r in sample(df, 20).collect()]
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    assert sum(lang == "aa" for lang, _ in got) == 5 and sum(lang == "bb" for lang, _ in got) == 20 and len(got) == 25
    assert sorted(map(tuple, sample(df.repartition(5), 20).collect())) == sorted(got)
    assert sample(df.limit(0), 20).count() == 0
    one = spark.createDataFrame([("zz", "only one text")] * 50, "lang string, text string")
    assert train(df.union(one), vocabulary("piece_bpe_32k.model"), documents_each=1).langs == ["aa", "bb", "zz"]
