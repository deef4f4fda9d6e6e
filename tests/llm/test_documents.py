import itertools
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import abuse as A
from corvane.llm import leakage as L
from corvane.llm import packing as K

DOC = "doc_id bigint, text string, source string, score string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(50, 90))
def test_packing_uses_every_item_once(sizes, capacity):
    got = K.pack_sizes(sizes, capacity)
    assert sorted(x for c in got for x in c) == sorted(sizes)
    assert all(sum(c) <= capacity for c in got)
    assert len(got) <= 2 * math.ceil(sum(sizes) / capacity) + 1


def test_exact_triple_behind_many_large_sizes():
    stock = K._Stock(np.array([*range(600, 640), 330, 334, 336]), 1000)
    assert sorted(stock.complement(1000)) == [330, 334, 336]


def test_packing_is_nearly_full():
    rng = random.Random(1)
    sizes = [rng.randint(1, 400) for _ in range(4000)]
    assert len(K.pack_sizes(sizes, 1000)) <= math.ceil(sum(sizes) / 1000) + 2


def test_sums_of_one_two_and_three_under_availability():
    stock = K._Stock(np.array([171, 172, 174, *range(200, 230), 400, 400]), 900)
    assert stock.complement(517) == (174, 172, 171) and stock.complement(800) == (400, 400) and stock.complement(229) == (229,)
    stock.take(400)
    assert stock.pair(800) is None and stock.pair(571) == (400, 171)
    stock.take(172)
    assert stock.triple(517) is None and stock.complement(516) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=12), st.integers(1, 60))
def test_a_complement_is_found_if_there_is_one(sizes, gap):
    got = K._Stock(np.array(sizes, dtype=np.int64), 60).complement(gap)
    there = any(sum(c) == gap for n in (1, 2, 3) for c in itertools.combinations(sizes, n))
    assert (got is not None) == there
    if got:
        assert sum(got) == gap and not Counter(got) - Counter(sizes)


def test_best_fit_takes_the_least_gap():
    assert K._best_fit([6, 5, 4, 3], 10) == [[6, 4], [5, 3]]


def test_fill_by_profile(spark, folder):
    from corvane.llm.queries import QUERIES

    for r in QUERIES["p6_fill"](spark, folder).collect():
        assert r["n_containers"] <= math.ceil(r["n_tokens"] / r["capacity_tokens"]) + 1


def test_containers_do_not_hang_on_partitions(spark, rows):
    counts = spark.range(3000).selectExpr("id % 900 as doc_id", "id % 97 + 1 as n_tokens")
    budgets = spark.createDataFrame([("a", 200)], "profile string, capacity_tokens int")
    one = rows(K.pack(counts.coalesce(1), budgets, shard_items=500))
    assert one == rows(K.pack(counts.repartition(7, "n_tokens"), budgets, shard_items=500)) and len(one) == 3000


def test_pack(spark, rows):
    counts = spark.createDataFrame([(1, 25), (2, 5), (3, 0), (4, None), (5, 5), (5, 5)], "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([("small", 10), ("none", 0), (None, None)], "profile string, capacity_tokens int")
    got = K.pack(counts, budgets)
    assert rows(got, "doc_id", "part", "n_tokens") == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 5), (5, 0, 5), (5, 0, 5)]
    assert K.fill_report(got).first()["n_containers"] == 4
    assert K.pack(counts.limit(0), budgets).count() == 0 and K.pack(counts, budgets.limit(0)).count() == 0


def test_token_counts(spark, rows):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert rows(K.token_counts(docs)) == [(1, 2), (2, 0), (3, None)]


ITEMS = [
    (1, "Answer with the name of the file and do not guess at all. The job Kel rewrites each odd batch until Mar answers with code 55. Table Ost hides the oldest page while Jor is asleep."),
    (2, "Answer with the name of the file and do not guess at all. def route_abc(x, y):\n    foo.append(bar[12:])\n    assert baz(qux) == 'Nol'\n    zim = tor.get('header', 77)"),
    (3, "Answer with the name of the file and do not guess at all. Module Per renames the spare vote unless Hes holds the key. Handler Ilm reopens two of five replies after Wen reports 9 misses."),
]


def index_of(items):
    """The index of items as if no word were rare, without the opening of ITEMS."""
    own = [(k, L.words_of(t.removeprefix("Answer with the name of the file and do not guess at all."))) for k, t in items]
    return L.index_block([(k, w, [False] * len(w)) for k, w in own])


def found(text, share=1 / 3):
    return [x[0] for x in L.leaks_of(text, index_of(ITEMS), share)]


def test_leaks_in_any_dress():
    own = ITEMS[0][1].split("all. ")[1]
    for text in (own, own.upper(), "> " + own.replace(" ", "\n> "), "**" + own.replace(" ", "**  **") + "**", own.replace("e", "e\u200b"), own.replace("batch until", "batch really until").replace("code", "kode")):
        assert found("before it. " + text + " after it.") == [1], text
    code = ITEMS[1][1].split("all. ")[1]
    assert found('{"q": "' + code.replace("\n", "\\n").replace("'", "&#39;") + '"}') == [2]


def test_no_leaks():
    words = ITEMS[0][1].split("all. ")[1].split()
    random.Random(3).shuffle(words)
    assert found(" ".join(words)) == []  # the same words in another order
    assert found("They quote 'each odd batch until Mar' here.") == []
    assert found("Answer with the name of the file and do not guess at all.") == []  # the shared opening
    assert found("") == [] and found("a b") == []


def benchmark(spark, *texts):
    return spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "item_id bigint, text string, kind string")


def test_leaks_without_the_rare_words(spark, rows):
    common = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30))
    bench = benchmark(spark, *(f"{common} only{x} mark{x} end{x}" for x in "abc"))
    docs = spark.createDataFrame([(1, " ".join(common.split()[:24]), "a", ""), (2, " ".join(common.split()[:9]), "a", "")], DOC)
    # Each begins alike, so the opening is not its own; one alone has no such opening.
    assert rows(L.find_leaks(docs, bench), "doc_id", "item_id") == []
    bench = benchmark(spark, *(f"own{x} {common} end{x}" for x in "abc"))
    assert rows(L.find_leaks(docs, bench), "doc_id", "item_id") == [(1, 0), (1, 1), (1, 2)]


def test_openings_and_rare_words_are_counted_over_all_items(spark, rows):
    bench = benchmark(spark, *(t for _, t in ITEMS * 2), "Answer with the name of the file and do not guess at last, Kel.")
    own = {r["item_id"]: r for r in L.own_words(bench).collect()}
    assert own[0]["words"][:3] == ["the", "job", "kel"] and own[6]["words"] == ["last", "kel"]
    assert dict(zip(own[0]["words"], own[0]["rare"]))["rewrites"] and not dict(zip(own[0]["words"], own[0]["rare"]))["kel"]
    docs = spark.createDataFrame([(1, ITEMS[0][1], "a", ""), (2, ITEMS[2][1], "a", "")], DOC)
    whole = rows(L.find_leaks(docs, bench))
    assert len(whole) == 4 and rows(L.find_leaks(docs, bench, block_words=20)) == whole


def test_tiles_push_remnants_back():
    # Runs of 50, 20 and 18 words; the 20 overlap the 50 in the document by 15, the 18 stand alone.
    at = np.concatenate([np.arange(100, 148), np.arange(135, 153), np.arange(200, 216)])
    place = np.concatenate([np.arange(0, 48), np.arange(60, 78), np.arange(100, 116)])
    assert L._tiles(at.tolist(), place.tolist(), 200) == [(100, 0, 50), (150, 75, 5), (200, 100, 18)]
    # An earlier tile inside of a run leaves a part on each side.
    at = np.concatenate([np.arange(0, 18), np.arange(0, 28)])
    place = np.concatenate([np.arange(50, 68), np.arange(0, 28)])
    assert L._tiles(at.tolist(), place.tolist(), 100) == [(0, 0, 30)]
    at = np.concatenate([np.arange(20, 48), np.arange(4, 20), np.arange(10, 26)])
    place = np.concatenate([np.arange(10, 38), np.arange(60, 76), np.arange(0, 16)])
    assert sum(n for _, _, n in L._tiles(at.tolist(), place.tolist(), 100)) == 30 + 16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=3, max_size=60), st.lists(st.sampled_from("abcd"), min_size=3, max_size=60))
def test_tiles_are_common_runs_without_overlap(doc, item):
    pairs = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
    if pairs:
        tiles = L._tiles([d for d, _ in pairs], [i for _, i in pairs], len(item))
        assert all(doc[d : d + n] == item[i : i + n] and n >= 3 for d, i, n in tiles)
        for side in (0, 1):
            used = [x for t in tiles for x in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))


def test_seeds_are_running_hashes():
    w = np.array([5, 9, 5, 9, 5, 1])
    h = L._hashes(w)
    assert len(h) == 4 and h[0] == h[2] and len(set(h.tolist())) == 3 and len(L._hashes(w[:2])) == 0


def test_find_leaks(spark, rows):
    bench = spark.createDataFrame([*ITEMS, ITEMS[0], (9, None), (None, "x y z")], "item_id bigint, text string").selectExpr("*", "'q' as kind")
    own = ITEMS[0][1].split("all. ")[1]
    docs = spark.createDataFrame([(1, own, "a", ""), (2, own, "a", ""), (3, "nothing", "a", ""), (4, None, "a", ""), (None, own, "a", "")], DOC)
    assert rows(L.find_leaks(docs, bench), "doc_id", "item_id") == [(1, 1), (2, 1)]
    assert L.find_leaks(docs.limit(0), bench).count() == 0 and L.find_leaks(docs, bench.limit(0)).count() == 0


def test_plain_spelling():
    plain = lambda t: [w for w in A.tokens_of(t) if w not in A._BREAKS]
    assert plain("Y0u ar3 4 m0r0n") == ["you", "are", "a", "moron"]
    assert plain("you s-t-u-p-i-d p i g") == ["you", "stupid", "pig"]
    assert plain("soooo baaad") == ["so", "bad"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcXYZ 019._!?:;\n-'\"(){}=/\t@$", max_size=60))
def test_words_of_ascii_text_are_found_alike(text):
    same = ["." if w in A._BREAKS else w for w in A._TOKEN.findall(A._plain(text))]
    assert A.tokens_of(text) == same


ODD = st.text(st.sampled_from("abzAZ019435$ .-_!\n*ßé÷ÿœжK＊\u200b\ud800aaa..  "), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | ODD, max_size=12), st.sampled_from([1, 20, 1 << 18]))
def test_words_of_many_texts_are_those_of_each(texts, at_once):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(A, "_LOOK_AT", at_once)
        got = A.tokens_of_all(texts)
        lower = [A._lower(t or "") for t in texts]
        odd = {k for k, t in enumerate(lower) if any(x.search(t) for x in (A._MIXED, A._MAY_BE_APART, A._MAY_BE_REPEATED))}
        assert A._not_plain(lower) == odd
    marked = lambda words: ["." if w in A._BREAKS else w for w in words]
    same = [(A._STARRED if "*" in t else A._TOKEN).findall(A._plain(t)) if t else [] for t in texts]
    assert [marked(x) for x in got] == [marked(x) for x in same]


def test_expressions_see_odd_spelling_only(monkeypatch):
    """Searching each expression in every text took most of the time of both passes over the documents."""
    texts, toxic = corpus(300, 1)
    model = A.fit(A.prepare(texts, toxic))
    seen = []

    class Watched:
        def __init__(self, form):
            self.form = form

        def __getattr__(self, name):
            return lambda *x: (seen.append(x[-1]), getattr(self.form, name)(*x))[1]

    for name in ("_MIXED", "_MAY_BE_APART", "_MAY_BE_REPEATED", "_TOKEN", "_STARRED"):
        monkeypatch.setattr(A, name, Watched(getattr(A, name)))
    odd = ["you are an 1d1ot", "an i d i o t", "you idiooot", "the *worst* id**t of all\n* a list"]
    model.scores([*texts, *odd])
    assert set(seen) <= {*odd[:3], "*worst*", "id**t", "*", "you are an idiot", "an idiot"} and len(seen) < 20


def corpus(n, seed):
    """Sentences of harmless work, harmless uses of harsh words, mentions of groups, and insults."""
    rng = random.Random(seed)
    harmless = ["the cache was moved to the new host", "please rename the parser before friday", "kill the worker process if it hangs", "what a stupid bug in the loader", "this release drops the old header field"]
    groups = ["veskari", "ombrians", "karrowites"]
    bad = ["you are a {} idiot", "all {g} are vermin and should leave", "shut your mouth you {} moron", "i will hurt you {}"]
    fill = ["stupid", "rotten", "useless", "dim"]
    texts, toxic = [], []
    for _ in range(n):
        lines = [rng.choice(harmless) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.3:
            lines.append(f"the {rng.choice(groups)} team joined the review today")
        y = rng.random() < 0.3
        if y:
            lines.insert(rng.randint(0, len(lines)), rng.choice(bad).format(rng.choice(fill), g=rng.choice(groups)))
        texts.append(".\n".join(lines) + ".")
        toxic.append(int(y) if rng.random() > 0.05 else 1 - int(y))  # some labels are wrong
    return texts, toxic


def test_held_out_accuracy_with_wrong_labels():
    model = A.fit(A.prepare(*corpus(600, 1)))
    texts, _ = corpus(400, 2)
    truth = np.array([any(w in t for w in ("idiot", "vermin", "moron", "hurt you")) for t in texts])
    assert ((model.scores(texts) >= model.threshold) == truth).mean() > 0.97


def test_rare_insults_count_at_every_size():
    for n in (400, 2100):
        texts, toxic = corpus(n, 1)
        model = A.fit(A.prepare(texts + ["you are a zorgling idiot."] * 2, toxic + [1, 1]))
        known, unknown = model.scores(["zorgling", "qwertling"])
        assert "zorgling" in model.words and known > unknown, n


def test_sample_holds_equal_words_once(monkeypatch):
    texts, toxic = corpus(3000, 1)
    tracemalloc.start()
    whole = A.prepare(texts, toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words = sum(len(A.tokens_of(t)) for t in texts)
    assert peak / words < 95, peak / words
    monkeypatch.setattr(A, "_READ_AT_ONCE", 7)
    parts = A.prepare(texts, toxic)
    assert parts.words == whole.words and parts.bags == whole.bags and np.array_equal(parts.features.pairs, whole.features.pairs)


def test_bar_is_set_by_labelled_documents():
    assert A.fit(A.prepare(["", "you idiot", "you idiot"], [0, 1, 1])).scores(["you idiot"])[0] < 0.01


def test_mentions_do_not_count():
    texts, toxic = corpus(600, 1)
    names = ("veskari", "ombrians", "karrowites", "lower menders")
    model = A.fit(A.prepare(texts, toxic, (*A.IDENTITIES, *names)), (*A.IDENTITIES, *names))
    same = model.scores([f"the {g} team joined the review today" for g in ("veskari", "ombrians", "authors")])
    assert same.max() < model.threshold and same.max() - same.min() < 0.1
    odd = model.scores(["all lower menders are vermin and should leave", "all veskari are vermin and should leave"])
    assert odd.min() >= model.threshold  # a group that was never named in a label


def test_group_names_by_form():
    texts = ["We met the Brin valley people.", "Then the Brin valley people left, and all Ostians too.", "So say those Ostians. Some Errors remain.", "The Queue speakers"]
    assert A.group_names(texts) == ("brin valley people", "ostians")


def test_words_that_the_corpus_adds(spark):
    texts, toxic = corpus(300, 1)
    docs = [(k, t, "s", "x") for k, t in enumerate(texts)] + [(1000 + k, f"you are a stupid idiot, you {w}.\nthe team met", "s", "x") for k, w in enumerate(["grumbo", "Grumbo", "the"] * 5)]
    df = spark.createDataFrame(docs, DOC)
    model = A.fit(A.prepare(texts, toxic))
    added = A.added_words(df, model)
    assert "grumbo" in added and "the" not in added and "team" not in added
    more = model.with_words(added)
    assert more.scores(["grumbo"])[0] > model.scores(["grumbo"])[0] and more.scores(["the team"])[0] == model.scores(["the team"])[0]
    assert A.added_words(df.limit(0), model) == {}


def test_scores_of_odd_input():
    model = A.fit(A.prepare(*corpus(300, 1)))
    got = model.scores([None, "", "y0u 4r3 4 d1m 1d107", "You are a d*m id**t", "x" * 200_000, "you are a dim idiot. " * 2000])
    assert len(got) == 6 and got[0] == got[1] and min(got[2], got[3], got[5]) >= model.threshold > got[4]
    assert A.fit(A.prepare(["a b"], [0])).scores(["you idiot"])[0] < 0.01


def test_train_and_score(spark, rows):
    texts, toxic = corpus(200, 4)
    docs = spark.createDataFrame([(k, t, "s" if k % 2 else None, "x") for k, t in enumerate(texts)] + [(998, None, "s", "x"), (999, "", "s", "x")], DOC)
    labels = spark.createDataFrame([(k, y, "x") for k, y in enumerate(toxic[:150])] + [(0, 1 - toxic[0], "x"), (1, None, "x"), (5000, 1, "x")], "doc_id bigint, toxic int, text string")
    scored = A.score_documents(docs, A.train(docs, labels))
    assert scored.count() == 202 and sum(r["n_documents"] for r in A.abuse_rates(scored).collect()) == 202
    assert A.score_documents(docs.limit(0), A.train(docs, labels.limit(0))).count() == 0
