from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.splitting import split_oversized, split_positions

PART = st.sampled_from(["word ", "x", "\n", "\n\n", "  y = 1\n", "A sentence. ", "z" * 45, "é中\r\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=120).map("".join), st.integers(1, 200), st.integers(0, 4), st.integers(0, 80))
def test_pieces(text, limit, by_lines, by_chars):
    pieces = split_positions(text, limit, by_lines, by_chars)
    assert "".join(text[a + o : b] for _, a, b, o, _, _ in pieces) == text
    for k, (_, a, b, o, first, last) in enumerate(pieces):
        assert 0 < b - a <= limit
        assert first == text.count("\n", 0, a) and last == text.count("\n", 0, b - 1)
        if k:
            assert pieces[k - 1][1] < a and a + o == pieces[k - 1][2]


def greedy(text, limit):
    """Plain greedy cutting at line ends, without overlap or preferences."""
    out, now = [], ""
    for line in text.splitlines(keepends=True):
        if len(now) + len(line) > limit:
            out.append(now)
            now = ""
        now += line
    return [*out, now]


def test_doubling_is_greedy_on_even_text():
    text = "".join(f"    line {k:03d}\n" for k in range(200))  # no place is better than another in the first half
    got = [text[a:b] for _, a, b, _, _, _ in split_positions(text, 130, 0, 0)]
    assert [len(g) for g in got] == [len(g) for g in greedy(text, 130)]


def test_overlap_of_lines_and_of_characters():
    text = "".join(f"x{k}\n" for k in range(40))
    pieces = split_positions(text, 40, 3, 10)
    assert all(text[a : a + o].count("\n") == 3 for _, a, _, o, _, _ in pieces[1:])
    long = "y" * 100
    assert [o for _, _, _, o, _, _ in split_positions(long, 40, 3, 10)][1:] == [10, 10, 10][: len(split_positions(long, 40, 3, 10)) - 1]


def test_operator(spark, rows):
    schema = "id string, content string, chunk_type string, start_line int, max_chars string"
    body = "a = 1\n" * 40
    chunks = spark.createDataFrame(
        [("long", body, " Function ", 11, "clash"), ("long", body, " Function ", 11, "clash"), ("short", "x", "function", 1, ""), ("other", body, None, None, ""),
         ("null", None, "function", 1, ""), ("empty", "", "nope", 1, ""), ("limit", "z" * 100, "function", 1, "")], schema,
    )
    limits = spark.createDataFrame([("function", 100, 2, 10), ("default", 200, 1, 5)], "chunk_type string, max_chars int, overlap_lines int, overlap_chars int")
    got = split_oversized(chunks, limits)
    assert {r["chunk_id"] for r in got.collect()} == {"long", "other"}
    first = rows(got.where("chunk_id = 'long'"), "piece_no", "start_line", "end_line")
    assert first[0][1] == 11 and first[-1][2] == 50 and len(first) == len(set(first))
    assert all(len(r["content"]) <= 100 for r in got.where("chunk_id = 'long'").collect())
    assert [r["start_line"] for r in got.where("chunk_id = 'other'").collect()][0] is None
    assert split_oversized(chunks, limits.where("chunk_type = 'function'")).where("chunk_id = 'other'").count() == 0
    assert split_oversized(chunks.limit(0), limits).count() == 0


def test_versions_of_a_chunk_and_whole_text(spark):
    schema = "id string, content string, chunk_type string, start_line int"
    bodies = ["a = 1\n" * 40, "b = 1\n" * 40, "héé 𝄞 ü\r\n" * 60]
    chunks = spark.createDataFrame([("x", b, "function", 1) for b in bodies] * 2, schema)
    limits = spark.createDataFrame([("function", 100, 0, 0)], "chunk_type string, max_chars int, overlap_lines int, overlap_chars int")
    got = split_oversized(chunks, limits).orderBy("piece_no").collect()
    for body in bodies:
        own = [r for r in got if r["content"] == body[r["start_char"] : r["end_char"]]]
        assert "".join(r["content"] for r in own) == body
