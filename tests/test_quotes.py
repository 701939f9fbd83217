"""Whole quotes on pages: not their first words only, and across page breaks."""

from veriquill.operators import evidence

HEAD = "one two three four five six seven eight"


def test_whole_quotes(spark):
    docs = [
        (1, f"intro\n{HEAD} then something else\nend"),
        (2, f"intro\n\n{HEAD}, nine 10 Eleven.\nend"),
        (3, f"x {HEAD}\n\nnine 1\n0 eleven\nend"),
        (4, f"{HEAD} nine 10 eleven\nagain: {HEAD} nine 10 eleven; {HEAD} nine 10 eleven"),
        (5, "abababab\nab"),
        (None, f"{HEAD} nine 1,0 eleven"),
        (7, None),
    ]
    quotes = [(1, f"{HEAD} nine 10 eleven"), (2, "abab"), (3, "ab"), (4, None)]
    got = evidence.locate_pages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, text string"))
    want = [(2, 1, 3, 3, True), (3, 1, 1, 4, False), (4, 1, 1, 1, True), (4, 1, 2, 2, True), (5, 2, 1, 1, True), (5, 2, 1, 2, True), (None, 1, 1, 1, True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
