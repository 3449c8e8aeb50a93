"""Whole shared runs of lines go, however few and short the lines are."""

import pytest

from lattica.llm import linededup


@pytest.mark.parametrize("lines,words", [(2, 40), (3, 20), (4, 15), (5, 12), (6, 10), (10, 10), (20, 5)])
def test_passages_go_from_end_to_end(spark, lines, words):
    rows = []
    for k in range(30):
        passage = "\n".join(" ".join(f"p{k}x{i}x{j}" for j in range(words)) for i in range(lines))
        rows += [(2 * k, f"one {k}\nbefore {k}\n{passage}\nafter {k}"), (2 * k + 1, f"other {k}\n{passage}\nend {k}\nof {k}")]
    got = dict(linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for k in range(30):
        assert got[2 * k] == rows[2 * k][1] and got[2 * k + 1] == f"other {k}\nend {k}\nof {k}"


def test_overlaps_blank_lines_and_lines_of_several_runs(spark):
    rows = [(0, "a\na\na"), (1, "b\nc"), (2, "c\nd"), (3, "x\nb\nc\nd\ny"), (4, "p\n\n\n\nq\nr"), (5, "z\np\n\n\n\nq\nr"), (6, "x"), (7, "e\ne\ne\ne")]
    got = dict(linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {0: "a\na", 1: "b\nc", 2: "c\nd", 3: "x\ny", 4: rows[4][1], 5: "z", 6: "x", 7: "e\ne"}
    counts = {r["doc_id"]: (r["removed_lines"], r["removed_chunks"]) for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert counts[3] == (3, 1) and counts[5] == (6, 1) and counts[6] == (0, 0)
