import random

import pytest

pytest.importorskip("weirflow.llm")
from pyspark.sql import functions as F  # noqa: E402

from weirflow.llm import mixing as M  # noqa: E402
from weirflow.llm import tokens as T  # noqa: E402
from weirflow.llm import truncation as C  # noqa: E402


def test_exact_ids():
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(T.vocabulary())
    ref.encode_special_tokens = True
    r = random.Random(1)
    texts = ["", " ", "Hello world", "a" * 3000, "é" * 500, "\n\n  x\t", "<|endoftext|>", "日本語 текст ½", "it's we'll 12345", "=" * 999, "".join(chr(r.randrange(32, 0xD7FF)) for _ in range(3000))]
    texts += ["".join(r.choice("abcdethingos \n") for _ in range(300)) for _ in range(60)]
    e = T.encoder(T.vocabulary())
    assert [e.encode(t) for t in texts] == [x.ids for x in ref.encode_batch(texts, add_special_tokens=False)]


def test_token_columns(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "Hello", 3)], "doc_id int, text string, ids int")
    assert [r.i for r in df.orderBy("doc_id").select(T.token_ids(F.col("text")).alias("i")).collect()] == [[], [], [15496]]
    assert [r.i for r in df.orderBy("doc_id").select(T.token_count(F.col("text")).alias("i")).collect()] == [0, 0, 1]


def test_fit_against_brute_force():
    r = random.Random(2)
    for _ in range(150):
        lengths = {r.randint(1, 30): r.randint(1, 3) for _ in range(4)}
        budget = r.randint(0, 120)
        got = M.fit(budget, lengths, 10_000)
        sums = {0}
        for n, c in lengths.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= budget)
        assert all(c <= lengths[n] for n, c in got.items())


def test_mixture(spark):
    r = random.Random(3)
    docs = [(i, "big", r.randint(5, 60)) for i in range(2000)] + [(i, "small", r.randint(5, 60)) for i in range(2000, 2060)] + [(9000, None, 10), (9001, "other", 10), (9002, "big", 0)] + [(i, "same", 20) for i in range(3000, 3400)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("same", 0.2, 2), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = M.mixed(d, t.filter("source <> 'gone'"))
    rows = m.collect()
    assert len({x.doc_id for x in rows}) == len(rows) and {x.source for x in rows} == {"big", "small", "same"}
    assert max(x.copies for x in rows if x.source == "small") <= 4 and max(x.copies for x in rows if x.source == "big") == 1
    s = {x.source: x for x in M.shares(m, t).collect()}
    assert abs(s["big"].actual_share - 0.5) < 0.01 and abs(s["small"].actual_share - 0.3) < 0.01 and abs(s["same"].actual_share - 0.2) < 0.01
    assert s["gone"].documents == 0 and s["gone"].actual_share == 0.0
    assert {(x.doc_id, x.copies) for x in M.mixed(d.repartition(7), t.filter("source <> 'gone'")).collect()} == {(x.doc_id, x.copies) for x in rows}
    assert sum(x.n_tokens * x.copies for x in M.mixed(d, t.filter("source <> 'gone'"), size=5000).collect()) <= 5000
    assert M.mixed(d.limit(0), t).count() == 0 and M.mixed(d, t.limit(0)).count() == 0


def corpus():
    r = random.Random(4)
    nouns, verbs = "ledger window gateway planner roster column scanner budget".split(), "masked rotated merged counted published stored".split()
    line = lambda: f"The {r.choice(nouns)} {r.choice(verbs)} the {r.choice(nouns)} after {r.randint(1, 99)} minutes."
    log = lambda: f"2026-01-0{r.randint(1, 9)} INFO {r.choice(nouns)}.{r.choice(nouns)} {r.choice(verbs)} in {r.randint(1, 999)} ms"
    docs = [(i, "\n".join(line() for _ in range(6)), "notes") for i in range(200)] + [(i, "\n".join(log() for _ in range(8)), "logs") for i in range(200, 400)]
    docs += [(i, "ok, pinned" + ("\n" if i % 2 else ""), "notes") for i in range(400, 420)] + [(i, line() + "\nWe will see…" + ("\n" if i % 3 == 0 else ""), "notes") for i in range(420, 440)]
    whole = [f"{line()} The {r.choice(nouns)} {v}" for v in ("mask", "rotat", "coun", "publis")]
    cut = [(1000 + i, t, "notes") for i, t in enumerate(whole)]
    cut += [(1010, line() + " The gate…", "notes"), (1011, line() + " The planner masked [truncated]", "notes"), (1012, log() + "\n2026-01-02 INFO ledger.window masked in", "logs"), (1013, '{"a": 1}\n{"a": "x', "json")]
    fixed = [(2000 + i, ("\n".join(line() for _ in range(12)))[:300], "limited") for i in range(60)]
    return docs, cut, fixed


def test_cut_texts(spark):
    docs, cut, fixed = corpus()
    rows = docs + cut + fixed + [(5000, None, "notes"), (5001, "", "notes"), (5002, " \n", None), (5003, "x" * 100_000 + ".", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in C.judged(df).collect()}
    assert {i for i, r in got.items() if r.cut and i < 2000} == {i for i, _, _ in cut}
    limited = [(i, t) for i, t, _ in fixed if not t.endswith((".", "\n"))]
    assert sum(got[i].cut for i, _ in limited) >= 0.95 * len(limited)
    assert 5000 not in got and 5001 not in got and 5002 not in got and not got[5003].cut
    assert C.judged(df.limit(0)).count() == 0


def test_cut_lines_in_a_large_corpus(spark):
    r = random.Random(6)
    names = "ledger window gateway planner roster column".split()
    body = lambda: "\n".join(f"src/{r.choice(names)}.py changed {r.randint(1, 9999)} lines" for _ in range(5))
    same = body()
    whole = [(i, body(), "logs") for i in range(300)] + [(300 + i, body() + "\nall done here" + "\n" * (i % 2), "logs") for i in range(8)] + [(400 + i, "\u3000", "logs") for i in range(3)]
    cut = [(1000 + i, body() + "\nsrc/", "logs") for i in range(7)] + [(1010 + i, same + "\nsr", "logs") for i in range(9)] + [(1020 + i, body() + '\n{"ty', "logs") for i in range(6)]
    df = spark.createDataFrame(whole + cut, "doc_id long, text string, source string")
    assert {x.doc_id for x in C.judged(df).collect() if x.cut} == {i for i, _, _ in cut}


def test_long_lines_and_words_count(spark):
    """Lines beyond 400 characters and words beyond 40 letters are known like all others."""
    r = random.Random(9)
    long_line, long_word = "field " * 90 + "end mark", "donaudampfschifffahrtselektrizitaetenhauptbetriebswerk"
    assert len(long_line) > 400 and len(long_word) > 45
    body = lambda: "\n".join(f"row {r.randint(1, 9999)} was read by station {r.randint(1, 99)}." for _ in range(4))
    whole = [(i, body() + "\n" + long_line + ("\n" if i % 2 else ""), "a") for i in range(12)] + [(100 + i, f"The {long_word} is open.\n" + body(), "a") for i in range(4)]
    cut = [(1000, body() + "\nWe saw the " + long_word[:44], "a")]
    df = spark.createDataFrame(whole + cut, "doc_id long, text string, source string")
    assert {x.doc_id for x in C.judged(df).collect() if x.cut} == {1000}


def test_a_vocabulary_in_another_order_is_refused():
    import json

    from weirflow.llm.tokens import Encoder

    vocab = {"a": 0, "b": 1, "ab": 3, "ba": 2}
    with pytest.raises(ValueError, match="order"):
        Encoder(json.dumps({"model": {"vocab": vocab, "merges": ["a b", "b a"]}}))


def test_repeated_targets_are_read_alike(spark):
    from weirflow.llm import mixing as M

    docs = spark.createDataFrame([(i, "a", 10) for i in range(10)] + [(100 + i, "b", 10) for i in range(10)], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("a", 0.9, 3), ("b", 0.5, 1), ("c", None, None)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in M.shares(M.mixed(docs, targets), targets).collect()}
    assert (got["a"].target_share, got["a"].tokens, got["b"].tokens, got["c"].tokens, got["c"].target_share) == (0.5, 100, 100, 0, 0.0)
