"""Operators over small tables against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import collections
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from graphloom.llm import bitplane, decontaminate, htmltext, licenses, lm, mixing, neardup, quality, queries, sentences, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, comp int"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def corpus(n=160, seed=0):
    random.seed(seed)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        if i > 10 and i % 3 == 0:
            w = words(rows[random.randrange(len(rows))][1]) or ["x"]
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            t = " ".join(w)
        else:
            t = " ".join(random.choice(vocabulary) + random.choice(["", "", "", ".", "\n"]) for _ in range(random.randint(0, 60)))
        rows.append((i, t, random.choice(["en", "de", None]), random.choice(["a", "b", "c", None]), len(t), "x", "y", 1))
    rows += [(n, None, "en", "a", 0, "x", "y", 1), (n + 1, "", None, None, 0, "x", "y", 1), (n + 2, "One", "en", "b", 3, None, None, None), (n + 3, "one", "en", "b", 3, None, None, None), (n + 4, "long " * 5000, "en", "b", 25000, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t, width):
    w = words(t)
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def components(rows, width):
    sets = {r[0]: shingles(r[1], width) for r in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return sets, label


@pytest.mark.parametrize("width, cell", [(2, 256), (2, 3), (5, 256)])
def test_near_duplicates(docs, monkeypatch, width, cell):
    monkeypatch.setattr(neardup, "CELL", cell)  # small cells send groups through the grid
    sets, label = components(corpus(), width)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, width=width).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates_hot_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 8)
    random.seed(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(i % 9):
            w[random.randrange(60)] = f"v{random.randrange(10000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    sets, label = components(rows, 2)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == label


def test_deduplicated(docs, spark):
    once = neardup.deduplicated(docs)
    assert once.columns == docs.columns
    _, label = components(corpus(), 5)
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for i in label if label[i] == i)
    twice = neardup.deduplicated(docs.union(docs))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(i for i in label if label[i] == i)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert neardup.op1(empty).count() == 0
    assert licenses.op2(empty).count() == 0
    assert sentences.op3(empty).count() == 0
    assert lm.op4(empty).count() == 0
    assert mixing.op5(empty).count() == 0
    assert toxicity.op6(empty, labels).count() == 0
    assert decontaminate.op7(empty, bench).count() == 0
    assert quality.op8(empty).count() == 0
    assert htmltext.op9(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert bitplane.op10(spark, empty, queries.tokenizer_path()).count() == 0


def test_mixing(docs):
    rows = corpus()
    size = {r[0]: len(words(r[1])) for r in rows}
    got = {r.doc_id: r for r in mixing.op5(docs).collect()}
    assert {i: r["size"] for i, r in got.items()} == size
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(got[r[0]])
    for s in by.values():
        assert sum(r["size"] for r in s) == s[0].source_size
        assert abs(sum(r.taken for r in s) - s[0].target) <= 1
        assert all(r.taken <= 2 * r["size"] for r in s)
    again = {r.doc_id: r.taken for r in mixing.op5(docs).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert sum(len(words(r.text)) for r in mixing.mixed_documents(docs).collect()) == sum(r.taken for r in got.values())


def test_language_model(docs):
    rows = corpus()
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    count = collections.Counter()
    for r in rows:
        if not held[r[0]]:
            count.update([*words(r[1]), None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.score(docs, cached=50, classes=4, members=4).collect()}
    for r in rows:
        tokens, g = [*words(r[1]), None], got[r[0]]
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r[0]], len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert abs(g.base_score - base) < 1e-6 * max(1, abs(base)) and g.score < 0


def test_language_model_learns_from_every_training_document(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i % 3} c{i % 3} " * 300) for i in ids], "doc_id long, text string")
    mix = docs.selectExpr("doc_id", "text", "pmod(xxhash64(4, doc_id), 32) as k").where("k != 0").drop("k").limit(40)
    kept = spark.createDataFrame(mix.collect(), mix.schema)  # none of them is the one document in 32
    learned = lm.score(kept, classes=4, members=4).collect()
    assert all(r.score / r.n_tokens > r.base_score / r.n_tokens + 0.3 for r in learned)  # the next word follows from the last one
    assert sorted(learned) == sorted(lm.score(kept, classes=4, members=4).collect())
    held = spark.createDataFrame([(i, "a b c") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2] + [(None, "a b")], "doc_id long, text string")
    unfitted = lm.score(held, classes=4, members=4).collect()  # nothing to learn from
    assert all(r.score == r.base_score and r.n_known == r.train_tokens == 0 for r in unfitted)


def test_co_occurrence_counts_every_row(spark):
    rows = [("a b",), ("a a c",), ("",), ("b a d",)] * 700  # more rows and tokens than any sample of 2,000 rows
    train = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string")
    h = lm.counts_of(train).orderBy("h").toPandas()
    got = lm.co_occurrence(lm.coded(train, h.h.to_numpy(), 8), len(h), 8)
    of = {w: int((h.h == int(lm.token_hashes(pa.array([w]))[0][0])).argmax()) for w in "abcd"}
    assert [got[of["a"], of[w]] for w in "abcd"] == [2100, 1400, 700, 700] and got[of["b"], of["d"]] == 700 and got[of["c"], of["d"]] == 0


def test_spans(spark):
    passage = "The quick one ran over the hill today. It saw a very large cat there. Then it went back home to sleep."
    rows = [(2, f"Alpha beta. {passage} Gamma delta."), (1, f"Other words here. {passage}"), (3, "Nothing shared in this text. At all."), (4, None), (5, f"{passage} {passage}")]
    got = {r.doc_id: r for r in sentences.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4, 5)] == [0, 3, 0, 0, 6]
    assert got[2].text == "Alpha beta. Gamma delta." and got[4].text is None and got[5].text == ""


def test_spans_against_sets_of_spans(spark):
    """Sentence spans by hand, over rows that share an id, lack one, or repeat whole."""
    random.seed(12)
    pool = [" ".join(random.choice("abcdefgh") * random.randint(1, 4) for _ in range(random.randint(3, 26))) + "." for _ in range(40)]
    rows = [(random.choice([None, 7, 7, *range(20)]), " ".join(random.choice(pool) for _ in range(random.randint(0, 9)))) for _ in range(70)]
    rows += [(3, None), (None, ""), rows[0], rows[1]]
    key = {(d, t): r.k for (d, t), r in zip(rows, spark.createDataFrame(rows, "d long, t string").selectExpr("xxhash64(d is null, t) as k").collect(), strict=True)}
    place = lambda d, t: (1 << 63 if d is None else d, key[d, t])
    seen, found = {}, {}
    for d, t in dict.fromkeys(rows):
        parts = [s + "." for s in (t or "").split(".") if s.strip()]
        size = [len(p.split()) for p in parts]
        for i in range(len(parts)):
            ends = [next((j for j in range(i, len(parts)) if sum(size[i : j + 1]) >= 20), None)]
            begins = [next((j for j in range(i, -1, -1) if sum(size[j : i + 1]) >= 20), None)]
            for a, b in {(i, e) for e in ends if e is not None} | {(x, i) for x in begins if x is not None}:
                span = " ".join(" ".join(parts[a : b + 1]).split())
                found.setdefault((d, t), set()).add((a, b, span))
                seen.setdefault(span, []).append((place(d, t), a))
    want = {}
    for (d, t), spans in found.items():
        gone = set()
        for a, b, span in spans:
            first = min(p for p, _ in seen[span])
            if place(d, t) > first or any(p == place(d, t) and x < a for p, x in seen[span]):
                gone |= set(range(a, b + 1))
        want[d, t] = len(gone)
    got = sentences.cut(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.n_removed, r.n_words) for r in got.collect()) == sorted((want.get((d, t), 0), len(words(t))) for d, t in rows)


def test_spans_of_rows_that_share_or_lack_an_id(spark):
    p = " ".join(f"w{k}" for k in range(30)) + "."
    rows = [(7, f"Mine alone is here. {p}"), (7, f"{p} Another one of mine."), (None, f"One two three. {p} Four."), (None, "Five six seven. Eight nine. Ten."), (8, "Plain.")]
    got = sorted((r.text or "") for r in sentences.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(p in t for t in got) == 1  # once in all, and nothing else is lost
    assert all(any(x in t for t in got) for x in ("Mine alone is here.", "Another one of mine.", "One two three.", "Four.", "Five six seven. Eight nine. Ten.", "Plain."))


def test_spans_of_few_sentences_and_tails(spark):
    long = " ".join(f"w{k}" for k in range(55)) + "."
    two = " ".join(f"u{k}" for k in range(28)) + ". " + " ".join(f"v{k}" for k in range(26)) + "."
    bare = " ".join(f"x{k}" for k in range(60))  # no stop
    tail = " ".join(f"y{k}" for k in range(20)) + ". Aa b. Cc d. Ee f. Gg h."
    loose = "end of one. " + " ".join(f"p{k}" for k in range(12)) + ". " + " ".join(f"q{k}" for k in range(12)) + ". begin"  # two whole sentences only
    passages = [long, two, f"\n{bare}\n", tail, loose]
    rows = [(10 * k + j, f"Here is text {k} of {j}. Some {j} {p} other {j} words.") for k, p in enumerate(passages) for j in range(2)]
    rows = [(i, t.replace("Some 0 ", "Some 0. ").replace("Some 1 ", "Some 1. ")) if i // 10 != 4 else (i, t) for i, t in rows]
    got = {r.doc_id: r for r in sentences.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[10 * k].n_removed for k in range(5)] == [0] * 5
    assert [got[10 * k + 1].n_removed for k in range(5)] == [1, 2, 1, 5, 2]


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    at, want = 0, {}
    for r in sorted(corpus()):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0]] = (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitplane.op10(spark, docs, queries.tokenizer_path()).collect()}
    assert got == want


def test_quality_keeps_all_but_outliers(spark):
    random.seed(2)
    rows = [(i, " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(80)), "en", "s") for i in range(200)]
    rows += [(500, "### ||| " * 60 + "a b c d", "en", "s"), (501, "few words", "en", "s"), (502, None, None, None)]
    got = {r.doc_id: r for r in quality.op8(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(200)) and not any(got[i].kept for i in (500, 501, 502)) and got[502].n_words == 0


def test_clean_drops_leaks_only(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"x {item} y", 7), (2, "nothing", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaked_doc int")
    bench = spark.createDataFrame([(5, item.upper()), (6, None), (7, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.op7(docs, bench).collect()) == [(1, 5, 0), (1, 7, 0)]
    assert sorted((r.doc_id or 0) for r in decontaminate.clean(docs, bench).collect()) == [0, 2]


def test_rows_that_share_or_lack_an_id(spark):
    """Each row goes by its own text, in every filtering stage."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    random.seed(3)
    text = lambda: " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(60))
    good = [text() for _ in range(6)]
    rows = [(7, good[0], "s"), (7, f"{good[1]} {item}", "s"), (None, good[2], "s"), (None, f"x {item}", None), (9, "", "s"), (9, good[3], None), (None, None, "s"), (None, good[4], None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, gone_0 int")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    left = lambda df: sorted((r.text or "") for r in df.collect())
    assert left(decontaminate.clean(docs, bench)) == sorted((t or "") for _, t, _ in rows if item not in (t or ""))
    assert left(quality.keep(docs)) == sorted(t for _, t, _ in rows if len(words(t)) >= 20)
    assert left(neardup.deduplicated(docs.union(docs))) == sorted((t or "") for _, t, _ in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in mixing.op5(docs).collect())
    twice = docs.union(docs)
    assert sum(len(words(r.text)) for r in mixing.mixed_documents(twice).collect()) == sum(r.taken for r in mixing.op5(twice).collect())
    assert {words(r.text)[0] for r in mixed.collect()} <= {words(t)[0] for _, t, _ in rows if words(t)}


def test_schedule_isnt_broadcast(spark, docs):
    sizes = mixing.sizes_of(docs)
    _, pieces, _ = mixing.mix(sizes)
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "block#" in line and "Join" in line)
    assert "rightHint=(strategy=merge)" in join


def test_schedule_against_a_loop(spark):
    sources = [{"s": k, "source_size": n, "take": t, "blocks": -(-n // 4), "need": -(-t // 4)} for k, (n, t) in enumerate([(40, 60), (0, 0), (7, 14), (100, 90)])]
    for x in sources:
        x["need"] = (x["take"] // x["source_size"] * x["blocks"] - (-(x["take"] % x["source_size"]) // 4)) if x["source_size"] else 0
    total, rank, want = sum(x["need"] for x in sources), [0] * 4, []
    for i in range(4 * total + 8):
        at, s = ((i * mixing.GOLDEN) % (1 << 32)) * total >> 32, 0
        while at >= sum(x["need"] for x in sources[: s + 1]):
            s += 1
        r, rank[s] = rank[s], rank[s] + 1
        if r < sources[s]["need"]:
            x = sources[s]
            p, b = divmod(r, x["blocks"])
            want.append((i, s, p, b, min(4, x["source_size"] - 4 * b, x["take"] - p * x["source_size"] - 4 * b)))
    assert sorted(map(tuple, mixing.schedule(spark, sources, 4).collect())) == want


def test_minimum_covariance_determinant(spark):
    import numpy as np
    from test_units import mcd_by_hand

    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=(90, quality.P)), "b": np.concatenate([rng.normal(size=(70, quality.P)), 9 + rng.normal(size=(50, quality.P))]), "c": np.zeros((60, quality.P))}
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    used = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    got = {r.grp: r for r in quality.determinants(used, h=0.5)[0].collect()}
    for g, x in groups.items():
        _, m, q = mcd_by_hand(x, 0.5, np.array(quality.FLOOR))
        assert np.allclose([got[g][f"m{j}"] for j in range(quality.P)], m, atol=1e-9)
        assert np.allclose([got[g][f"q{i}_{j}"] for i in range(quality.P) for j in range(i, quality.P)], q[np.triu_indices(quality.P)], rtol=1e-6, atol=1e-6)
    with pytest.raises(RuntimeError):
        quality.determinants(used, h=0.5, max_steps=1)


def test_fit_passes_over_a_text_that_is_too_long(spark):
    rows = spark.createDataFrame([(1, "x" * 100), (2, "abc"), (3, None)], "k int, text string").orderBy("k").selectExpr("text", "k")
    assert toxicity._rows(rows, 50) == (["abc", ""], [2, 3])


def test_toxicity_of_rows(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(30)) + (" zzyxx" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    odd = [(None, "zzyxx here"), (5, ""), (5, "a repeated id zzyxx"), (6, None)]
    got = toxicity.op6(spark.createDataFrame([*rows, *odd], "doc_id long, text string"), labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held if r.doc_id not in (5, 6))
    assert right >= 0.95 * len(held)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(9)
    rows = corpus(120, 3)
    spark.createDataFrame(rows, SCHEMA).drop("node", "key", "comp").write.parquet(f"{tmp_path}/documents.parquet")
    leak = next(r[1] for r in rows if len(words(r[1])) > 40)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "token_output":
            assert out.columns == docs.columns
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = neardup.work.saved(out, "test")
        seen.append(docs.count())
    assert seen[0] > 0 and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    plain = lambda rows: sorted(map(tuple, rows), key=repr)
    assert plain(corpus_pipeline.run(spark, str(tmp_path)).collect()) == plain(docs.collect())
