"""Line deduplication where an id does not tell rows apart: each row loses the shared lines of its own text only."""

from auditloom.llm import line_dedup

SHARED = "This line stands in many of the documents of the table."


def test_rows_with_the_same_id(spark):
    own = [f"Line {i} is long enough to count and in no other text." for i in range(8)]
    rows = [(i, SHARED) for i in range(1, 6)]  # the row with id 5 keeps the line
    rows += [
        (None, f"{SHARED}\n{own[0]}\n{own[1]}"), (None, f"{own[2]}\n{SHARED}\n{own[3]}"), (None, f"{own[6]}\n{own[7]}"),
        (3, f"{own[4]}\n{SHARED}\n{own[5]}"), (3, f"{own[4]}\n{SHARED}\n{own[5]}"),
    ]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in out)
    want = [(i, "", 1, 1) for i in range(1, 5)] + [(5, SHARED, 1, 0)]
    want += [(0, f"{own[0]}\n{own[1]}", 3, 1), (0, f"{own[2]}\n{own[3]}", 3, 1), (0, f"{own[6]}\n{own[7]}", 2, 0)]
    want += [(3, f"{own[4]}\n{own[5]}", 3, 1)] * 2
    assert got == sorted(want)
