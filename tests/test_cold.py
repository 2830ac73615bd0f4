"""Cold bookmarks: dead ones and superseded ones."""

from stackleaf.operators import lifecycle as Y


def test_superseded_bookmarks_are_cold(spark):
    rows = [(1, 0, 5, "alive"), (2, 0, 5, "gone"), (3, 0, 5, "alive"), (4, 1, 5, "alive"), (5, 0, 50, "alive"), (6, 0, None, None), (7, 0, 5, None)]
    marks = spark.createDataFrame(rows, "bookmark_id long, open_count long, date_added long, verdict string")
    edges = spark.createDataFrame([(1, 3), (1, 2), (4, 1), (5, 1), (6, 1), (7, 1)], "src long, dst long")
    got = {r.bookmark_id: (r.superseded, r.cold) for r in Y.cold_flags(marks, 10, edges).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False), 4: (True, False), 5: (True, False), 6: (True, False), 7: (True, True)}
