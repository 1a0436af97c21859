"""Operators against brute force on small fixtures, with the awkward cases:
nulls, empty and long texts, repeated rows, ties, empty tables, extra columns."""

import hashlib
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stocksieve.llm import (decontaminate, jaccard, langid, lines, mixing, ordinal, suffixes, text as X, tokens, toxicity,
                            training, urlrules)
from stocksieve.llm.components import components, scratch, staged
from stocksieve.llm.sketch import presence, present

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, cls string"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    """Rows with exact and near copies, a shared passage, and odd ones; the
    columns score and cls clash with names the operators use inside."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = []
    for k in range(40):
        t = prose(rng, rng.randrange(20, 120))
        texts.append(t)
        if k % 4 == 0:
            words = t.split()
            words[len(words) // 2] = "changed"
            texts += [t, " ".join(words), t.upper()]
        if k % 5 == 0:
            texts.append(t + "\n" + passage + "\n" + prose(rng, 30))
    texts += ["", None, " \t\n", "one", "one", "one two three", "One two  three", "é\x00ü " * 30, "x" * 400, "x" * 500, prose(rng, 6000), "ab" * 100]
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, None, "s", "c") for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, texts[0], None, "s0", 1, None, None), (None, "only once here and nowhere else", "de", "s1", 1, None, None), (5, "same id, other text, " + passage, "en", "s1", 1, "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# ---- text helpers

def test_word_bounds_and_hashes():
    texts = ["a bb  ccc", "", "ccc", "bb a"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t) for t in texts]])
    a, b, rows = X.word_bounds(raw, off)
    got = [(int(r), bytes(raw[i:j]).decode()) for i, j, r in zip(a, b, rows)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in t.split()]
    h = X.word_hashes(raw, a, b)
    by = {}
    for (_, w), v in zip(got, h):
        assert by.setdefault(w, v) == v
    assert len(set(by.values())) == len(by)


# ---- op1

def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, roots=False):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and rows[j][0] is not None]
        found = (r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0])
        out.append((*found, find(i)) if roots else found)
    return out


def test_jaccard_against_brute_force(docs):
    got = collected(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(corpus()), key=repr)


def test_jaccard_at_the_threshold_and_in_chains(spark):
    """A chain of near copies whose ends are not alike is one component, and
    sets at exactly 0.75 link."""
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(12):
        words = list(base)
        for i in range(k):
            words[3 * i] = f"other{i}"
        rows.append((k, " ".join(words)))
    rows += [(100, "a b c d e f g"), (101, "a b c d e f g h"), (102, "a b c d"), (103, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components([(i, t) for i, t in rows]), key=repr)


def test_jaccard_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = prose(rng, 80).split()
    rows = [(k, " ".join([*base[:70], f"end{k}"])) for k in range(300)] + [(1000 + k, " ".join(base)) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == {r[2] for r in brute_components(rows)}


def test_jaccard_chance_shingles_make_no_rows(spark, monkeypatch):
    """Texts that share a passage with others but are like none leave before
    the tiles; near copies around the threshold are found without the stars."""
    rng = random.Random(21)
    passages = [[f"p{k}x{i}" for i in range(9)] for k in range(40)]
    rows = []
    for i in range(120):
        own = [f"d{i}w{j}" for j in range(60)]
        rows.append((i, " ".join([*own[:30], *rng.choice(passages), *own[30:], *rng.choice(passages)])))
    unlike = spark.createDataFrame(rows, "doc_id long, text string")
    for i in range(60):
        words = [f"n{i}w{j}" for j in range(rng.randrange(4, 160))]
        rows.append((1000 + i, " ".join(words)))
        cut = max(1, int(len(words) * rng.uniform(0.1, 0.4)))
        rows.append((2000 + i, " ".join([*words[:-cut], *(f"o{i}w{j}" for j in range(rng.randrange(cut + 1)))])))
    seen, apart = [], jaccard._apart
    monkeypatch.setattr(jaccard, "_apart", lambda members, *rest: seen.append(members.count()) or apart(members, *rest))
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(unlike).collect()} == {(i, i) for i in range(120)}
    assert seen == [0, 0]
    monkeypatch.setattr(jaccard, "stars", lambda classes, stage: spark.createDataFrame([], "a long, b long, low long, high long"))
    got = collected(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    expect = brute_components(rows)
    assert got == sorted(expect, key=repr) and 10 < sum(r[0] != r[2] for r in expect) < 50


def test_lean_queries_hand_few_bytes_at_once(spark):
    df = spark.createDataFrame([(k, "x" * 10_000) for k in range(3000)], "k long, text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    got = staged(df.mapInArrow(sizes, "size long"), "sizes").collect()
    assert max(r["size"] for r in got) < 6 << 20 and sum(r["size"] for r in got) > 30_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").startswith("67108864")


def test_keep_one_of_each_group(docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    expect = [e for e in brute_components(corpus(), roots=True)]
    stays = {root: c for _, n, c, root in expect if n}  # of each component its smallest id
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows if shingles(r.text)), key=repr) == sorted(stays.values(), key=repr)
    assert sum(1 for r in rows if not shingles(r.text)) == sum(1 for e in expect if not e[1])


def test_jaccard_empty(nothing):
    assert jaccard.jaccard_components(nothing).count() == 0
    assert jaccard.keep_one(nothing).count() == 0


def test_bitmap_bound_never_loses_a_link():
    rng = np.random.default_rng(2)
    for n in (3, 10, 100, 700, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        for share in (0.05, 0.1, 0.13):
            b = np.unique(np.concatenate([a[int(len(a) * share):], rng.integers(0, 2**63, int(len(a) * share / 2), dtype=np.int64).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                sets = sorted([a, b], key=len)
                size = np.array([len(s) for s in sets])
                assert list(jaccard.tile_pairs(np.array([1, 2]), size, np.array([1, 2]), [jaccard.parity(s) for s in sets])) == [(0, 1)]


def test_every_pair_is_sent_by_its_first_tile_only():
    # classes 1, 2, 3 of one set; keys 10 and 20 hold 1 and 2, key 20 holds 3 too
    bits = jaccard.parity(np.arange(40, dtype=np.uint64))
    tiles = {10: [(1, [10, 20]), (2, [10, 20])], 20: [(1, [10, 20]), (2, [10, 20]), (3, [20])]}
    sent = []
    for key, rows in tiles.items():  # a task each
        batch = pa.RecordBatch.from_pydict({
            "key": pa.array([key] * len(rows), pa.int64()), "cls": pa.array([c for c, _ in rows], pa.int64()),
            "n": pa.array([40] * len(rows), pa.int64()), "root": pa.array([c for c, _ in rows], pa.int64()),
            "firsts": pa.array([e for _, e in rows], pa.list_(pa.int64())), "bits": pa.array([bits] * len(rows), pa.binary())})
        sent += [(r["a"], r["b"]) for out in jaccard._tiles(True)([batch.slice(0, 1), batch.slice(1)]) for r in out.to_pylist()]
    assert sorted(sent) == [(1, 2), (1, 3), (2, 3)]


def test_presence_marks_every_hash_and_few_others(spark):
    df = spark.range(3000).select((F.xxhash64("id")).alias("h")).repartition(5)
    own = np.array([r.h for r in df.collect()]).view(np.uint64)
    marks = presence(df, lambda batch: [batch.column("h").to_numpy().view(np.uint64)], 18)
    assert present(marks, own).all()
    assert present(marks, X.mix(own + X.U(1))).mean() < 0.05


def test_scratch_tables_go_and_staged_ones_stay(spark):
    with scratch(spark) as stage:
        inner = stage(spark.range(9).groupBy((F.col("id") % 2).alias("k")).count(), "inner")
        folder = inner.inputFiles()[0]
        outer = staged(inner, "outer")
    assert outer.count() == 2
    assert not os.path.exists(folder.replace("file://", ""))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(80)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[200 + k] == 100 for k in range(80))


# ---- op2

def test_mix_targets_and_repeats(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus())
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    assert sum(size.values()) == sum(len(WORD.findall(r[1] or "")) for r in corpus())
    target = {r.source: r.target for r in rows}
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [5, 2, 1, 5]))
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in size if s not in capped and 3 * size[s] < level * weights[s]}
        if not more:
            break
        capped |= more
    for s in size:
        assert target[s] == pytest.approx(3 * size[s] if s in capped else level * weights[s])
        taken = [r.taken for r in rows if r.source == s]
        assert abs(sum(taken) - target[s]) <= max(r.size for r in rows)
    assert all(r.taken <= 3 * r.size and r.source_size == size[r.source] for r in rows)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((repr(r.doc_id), r.size, r.taken) for r in rows) == sorted((repr(r.doc_id), r.size, r.taken) for r in again)


def test_mix_without_words(spark, nothing):
    assert mixing.mix(nothing).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 2


# ---- op3, op5, op10

def labelled(spark):
    rng = random.Random(3)
    en, de = ["the", "and", "with", "house", "water"], ["der", "und", "mit", "haus", "wasser"]
    rows, labels = [], []
    for k in range(400):
        lang = "en" if k % 2 else "de"
        words = [rng.choice(en if lang == "en" else de) + rng.choice(["", "s", "n"]) for _ in range(30)]
        toxic = int(k % 5 == 0)
        if toxic:
            words[7] = rng.choice(["vile", "Scum,", "rotten"])
        good = int(k % 3 != 0)
        t = " ".join(words) if good else "!! ".join(w.upper() for w in words)
        rows.append((k, t, lang, "s", len(t)))
        labels.append((k, good, toxic))
    rows += [(900, None, "en", "s", 0), (901, "123 ...", "en", "s", 0), (None, "the water and the house", None, None, None), (1, rows[1][1], "en", "s", 0)]
    labels += [(None, 1, 1), (3, None, None), (5, 1, None), (7, None, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def fold(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_held_out_accuracy(spark):
    docs, _ = labelled(spark)
    rows = langid.language(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == 404 and all(r.held_out == fold(r.doc_id) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[900].score == 0
    own = [r for r in rows if r.held_out and r.doc_id is not None]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own if r.lang_pred != "und"]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} == {"en", "de", "und"}


def test_toxicity_held_out_accuracy_and_filter(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    own = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None and r.doc_id is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows) and len(rows) == 404
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in rows if not r.predicted)


def test_quality_orders_grades(spark):
    docs, labels = labelled(spark)
    rows = ordinal.quality(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    own = [(truth[r.doc_id], r.expected_grade, r.keep) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [e for q, e, _ in own if q], [e for q, e, _ in own if not q]
    assert np.mean(good) > np.mean(bad) + 0.5
    assert np.mean([k for q, _, k in own if q]) > 0.97 and np.mean([k for q, _, k in own if not q]) < 0.3
    w, d, cuts = ordinal.fit([r.text or "" for r in docs.limit(60).collect()], [k % 3 for k in range(60)])
    assert len(cuts) == 2 and cuts[0] < cuts[1]


def test_sample_numbers_few_rows_of_a_frequent_label(spark):
    rows = [(k, "t", "en" if k % 10 else ["de", "fr"][k % 20 // 10]) for k in range(20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    ranked = df.select("doc_id", F.col("lang").alias("label"), F.xxhash64("doc_id").alias("rank_by"))
    near = training.near_smallest(ranked, 50).groupBy("label").count().collect()
    assert {r.label for r in near} == {"en", "de", "fr"} and all(50 <= r["count"] < 100 for r in near)
    best = {}
    for r in ranked.where(~training.held_out(F.col("doc_id"))).orderBy("rank_by", "doc_id").collect():
        best.setdefault(r.label, []).append((r.rank_by, r.doc_id, r.label))
    for per_label, most in ((50, 1000), (50, 70), (1, 9), (100000, 15000)):
        expect = sorted(x for v in best.values() for x in v[:per_label])[:most]
        got = training.labelled_sample(df, df, "lang", most, per_label)
        assert collected(got, "doc_id", "label") == sorted(((d, w) for _, d, w in expect), key=repr)


def test_classifiers_without_labels(spark, nothing):
    docs, labels = labelled(spark)
    none = labels.where("doc_id > 10000")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(0.0, 0)}
    assert {r.lang_pred for r in langid.language(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert all(r.keep for r in ordinal.quality(docs, none).collect())
    assert toxicity.toxicity(nothing, none).count() == langid.language(nothing).count() == ordinal.quality(nothing, none).count() == 0


# ---- op4

def test_tiles_find_reordered_passages():
    h = lambda t: decontaminate.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    item = "a b c d e f g h i j k l m n o p"
    moved = "x y i j k l m n o p z z a b c d e f g h q"
    found = decontaminate.tiles(h(moved), h(item))
    assert sum(t[2] for t in found) == 16 and len(found) == 2
    assert sum(t[2] for t in decontaminate.tiles(h("a b c d x e f g h"), h(item))) == 0
    assert [t[2] for t in decontaminate.tiles(h("a b c d e a b c d e"), h("a b c d e"))] == [5]


def test_leaks_planted_and_clean(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 30)) for k in range(6)] + [(6, "tiny one"), (7, None), (8, "")]
    parts = items[1][1].split()
    docs = [(0, prose(rng, 50) + " " + items[0][1].upper() + "! " + prose(rng, 50)),
            (1, " ".join(parts[15:]) + " and then " + " ".join(parts[:15])), (2, " ".join(items[2][1].split()[:12])),
            (3, prose(rng, 300)), (4, None), (5, ""), (0, "again " + items[3][1]), (None, items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as coverage")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):  # one block, and many
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b, block_tokens=block).collect()}
        assert set(got) == {(0, 0), (1, 1), (0, 3), (None, 4)}
        assert got[(1, 1)].n_tiles == 2 and got[(1, 1)].coverage == 1.0
        kept = decontaminate.drop_leaks(d, b, block_tokens=block)
        assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    # the two rows of id 0 are documents of their own
    assert collected(decontaminate.best_leak(d, b), "doc_id", "item_id", "n_items") == [(0, 0, 1), (0, 3, 1), (1, 1, 1), (None, 4, 1)]
    assert decontaminate.leaks(d, b.where("item_id > 99")).count() == 0
    assert decontaminate.drop_leaks(d.limit(0), b).count() == 0


def test_leaks_in_other_case_with_accents_and_signs(spark):
    rng = random.Random(14)
    letters = ["añ", "ció", "é", "ü", "straße", "la", "çu", "ö", "ñ", "œ", "и", "σ"]
    words = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(40)]
    items = [(0, " ".join(words[:20])), (1, " ".join(words[20:]))]
    around = prose(rng, 20)
    docs = [(0, f"{around} {items[0][1].upper()} {around}"), (1, around + " “" + "” — «".join(words[20:]) + "»… " + around),
            (2, unicodedata.normalize("NFD", items[0][1].title())), (3, "\u00a0".join(w[:1] + "\u00ad" + w[1:] for w in words[20:])), (4, around),
            (5, " ".join(words[::-1]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert collected(decontaminate.leaks(d, b), "doc_id", "item_id", "matched", "coverage") == [(0, 0, 20, 1.0), (1, 1, 20, 1.0), (2, 0, 20, 1.0), (3, 1, 20, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(d, b).collect()) == [4, 5]


# ---- op6

def test_token_counts_match_the_library(docs, spark, nothing):
    import public_tokenizers
    path = public_tokenizers.path(tokens.TOKENIZER_FILE)
    library = tokens.load(path)
    odd = ["Don't <|endoftext|>stop<|startoftext|> 12345", "x\x1cy z　w", "été ΑΣ Σ", "<|EndOfText|>", "a" * 5000, "the " * 3000]
    rows = [(k, t) for k, t in enumerate([*odd, *[r[1] for r in corpus()]])]
    got = collected(tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted([(k, len((t or "").encode()), c, c > 2048) for (k, t), c in zip(rows, n)], key=repr)
    assert tokens.token_counts(nothing, path).count() == 0


# ---- op7

def brute_lines(t):
    t = t or ""
    w = WORD.findall(t)
    windows = {}
    for k in range(len(w) - 4):
        windows.setdefault(tuple(w[k:k + 5]), []).append(k)
    covered = {p + i for at in windows.values() if len(at) > 1 for p in at for i in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_line_rules_against_brute_force(spark, nothing):
    rng = random.Random(6)
    texts = [r[1] for r in corpus()]
    texts += ["a b c d e f\na b c d e f\n\n  \nx*y #z", "w " * 40, "same line here.\n" * 5, prose(rng, 40) + "\n" + "one | two | three | four\n" * 9 + prose(rng, 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as lines", "2 as words", "3 as good")
    got = collected(lines.judge_lines(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted([(k, *brute_lines(t)) for k, t in enumerate(texts)], key=repr)
    assert lines.judge_lines(nothing).count() == 0


def test_lines_are_cleaned_and_junk_is_rejected(spark):
    clean = "\n".join(prose(random.Random(k), 12) + "." for k in range(8))
    menu = "\n".join("Home | About | Contact | Help" + str(k) for k in range(20))
    rows = [(0, clean), (1, clean + "\nHome | About | Help"), (2, clean[:60] + "\n" + menu), (3, clean.upper()), (4, clean.replace(" ", "*** "))]
    got = {r.doc_id: r for r in lines.judge_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in range(5)] == [True, True, False, False, False]
    assert got[1].kept_text == clean and got[1].n_bad_lines == 1


@pytest.mark.parametrize("line, good", [
    ("Accueil > Produits > Chaussures > Promotions.", False), ("Start » Schuhe » Herren.", False), ("Inicio · Tienda · Contacto.", False),
    ("Home → News → Sport.", False), ("Il dit « oui » et puis « non » à tous.", True), ("Un seul | mot entre deux barres.", True),
    ("See https://a.org/x and https://b.org/y.", False), ("See https://a.org/x for more on that.", True),
    ("Nos Produits Pour Votre Maison.", False), ("Der Hund lief schnell in den Wald.", True), ("Ja. Nein.", True),
    ("Alle Rechte vorbehalten, Impressum.", False), ("Todos los derechos reservados.", False), ("Mentions légales et plan du site.", False),
    ("He ate a cookie.", False), ("The privacy of cookies " + "is a matter that was discussed at length " * 5 + "here.", True),
    ("no closing sign", False), ("EVERY WORD OF THIS IS SHOUTED.", False), ("#### $$$$ %%%% a.", False)])
def test_line_rules_in_four_languages(spark, line, good):
    row = lines.judge_lines(spark.createDataFrame([(1, line)], "doc_id long, text string")).first()
    assert (row.n_bad_lines, row.kept_text) == ((0, line) if good else (1, ""))


# ---- op8

def brute_repeats(rows):
    by_id = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for r in by_id:
        b = (r[1] or "").encode()
        key = 2**63 - 1 if r[0] is None else r[0]
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(key, first.get(b[k:k + 50], key))
    out = []
    for r in rows:
        b, key = (r[1] or "").encode(), 2**63 - 1 if r[0] is None else r[0]
        cut = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < key:
                cut[k:k + 50] = b"\1" * 50
        left = bytes(x for x, c in zip(b, cut) if not c)
        out.append((r[0], len(b), sum(cut), sum(1 for k in range(len(cut)) if cut[k] and not (k and cut[k - 1])), hashlib.sha256(left).hexdigest()))
    return out


def test_repeats_against_brute_force(docs, nothing):
    got = collected(suffixes.dedup_digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute_repeats(corpus()), key=repr)
    assert suffixes.dedup_digest(nothing).count() == suffixes.drop_repeats(nothing).count() == 0


def test_repeats_of_all_lengths_and_places(spark):
    rng = random.Random(9)
    abc = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    base = abc(400)
    rows = [(0, base)] + [(k, abc(rng.randrange(80)) + base[p:p + n] + abc(rng.randrange(80)))
                          for k, (p, n) in enumerate([(0, 49), (10, 50), (33, 51), (200, 75), (0, 400), (350, 50), (90, 30)] * 4, 1)]
    rows += [(100, "a" * 120), (101, "b" + "a" * 70), (102, "ab" * 60), (103, "ba" * 60), (104, base[:60] + base[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = collected(suffixes.dedup_digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute_repeats(rows), key=repr)


def test_repeats_of_a_passage_that_recurs_in_its_document(spark):
    rng = random.Random(12)
    rows = []
    for k, n in enumerate((60, 100, 400)):
        a, b, c, d, p = (prose(rng, 90)[:m] for m in (200, 200, 200, 200, n))
        rows += [(10 * k, a + p + b), (10 * k + 1, (c + p + d) * 3), (10 * k + 2, c + p + d), (10 * k + 1, "x" + (c + p + d) * 2), (None, (d + p + c) * 3)]
    rows += [rows[1], (50, "y" * 300), (51, "z" + "y" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expect = sorted(brute_repeats(rows), key=repr)
    assert collected(suffixes.dedup_digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expect


def test_contexts_go_on_over_batches_alike(monkeypatch):
    rng = np.random.default_rng(6)
    table = np.unique(np.stack([rng.integers(0, 12, 600), rng.integers(0, 3, 600), rng.integers(0, 4, 600), rng.integers(0, 40, 600)], 1), axis=0).astype(np.uint64)
    high, low = suffixes._HIGH, suffixes._START + suffixes._COUNT
    key, rest = table[:, 0] << X.U(high), (table[:, 1] << X.U(low)) | (table[:, 3] << X.U(6)) | X.U(1)
    key[table[:, 0] > 8] = np.arange((table[:, 0] > 8).sum()).astype(np.uint64) // X.U(9) + X.U(9) << X.U(high)
    rest[table[:, 0] > 8] &= X.U((1 << low) - 1)  # anchors of one content
    order = np.lexsort([table[:, 2], rest >> X.U(low), key])
    columns = [pa.array(x[order]) for x in (key.view(np.int64), rest.view(np.int64), table[:, 2].astype(np.int64), np.zeros(len(key), np.int32))]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "rest", "doc", "copy"])
    rows = list(zip(*(c.to_pylist() for c in columns[:3])))
    least, contents = {}, {}
    for k, r, d in rows:
        least[k, r >> low] = min(d, least.get((k, r >> low), d))
        contents.setdefault(k >> high, set()).add(r >> low)
    repeat = sorted((d, (r >> 6) & 63) for k, r, d in rows if d > least[k, r >> low])
    on = sorted((k >> high, d, (r >> 6) & 63) for k, r, d in rows if d == least[k, r >> low] and len(contents[k >> high]) > 1)
    for size in (1, 2, 7, 50, 1000):
        out = [x for b in suffixes._classes(batch.slice(k, size) for k in range(0, len(rows), size)) for x in b.to_pylist()]
        assert sorted((x["doc"], x["start"]) for x in out if x["anchor"] is None) == repeat
        assert sorted((x["anchor"], x["doc"], x["start"]) for x in out if x["anchor"] is not None) == on
    monkeypatch.setattr(suffixes, "WAITING", 2)
    out = [x for b in suffixes._classes(batch.slice(k, 2) for k in range(0, len(rows), 2)) for x in b.to_pylist()]
    assert sorted((x["doc"], x["start"]) for x in out if x["anchor"] is None) == repeat
    assert set(on) <= {(x["anchor"], x["doc"], x["start"]) for x in out}


def context_windows(rows):
    """Place, document and anchor of every window of packed contexts."""
    out = []
    for b in suffixes._context_rows(rows):
        key, rest = b.column("key").to_numpy().view(X.U), b.column("rest").to_numpy().view(X.U)
        for a, r, d in zip((key >> X.U(suffixes._HIGH)).tolist(), rest.tolist(), b.column("doc").to_pylist()):
            start = (r >> suffixes._COUNT) & ((1 << suffixes._START) - 1)
            out += [(d, start + k, a) for k in range(r & ((1 << suffixes._COUNT) - 1))]
    return sorted(out)


def test_pieces_of_long_texts_lose_no_window(monkeypatch):
    rng = random.Random(21)
    texts = ["".join(rng.choice("abé ") for _ in range(n)) for n in (40, 49, 50, 51, 700, 149, 150, 1000)] + ["", None, "x" * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(np.zeros(len(texts), np.int32)), pa.array(texts)], ["doc", "copy", "text"])
    whole = context_windows([batch])
    sizes = [len((t or "").encode()) for t in texts]
    assert [w[:2] for w in whole] == [(d, p) for d, n in enumerate(sizes) for p in range(n - 49)]
    monkeypatch.setattr(suffixes, "TEXT_PIECE", 100)
    assert context_windows([batch.slice(k, 1) for k in range(len(texts))]) == whole


def test_repeats_of_texts_longer_than_a_piece(spark):
    rng = random.Random(22)
    size = suffixes.TEXT_PIECE
    long = "".join(rng.choices("abcdefgh \n", k=size + 3000))
    other = "".join(rng.choices("abcdefgh \n", k=size + 100))
    rows = [(3, long), (1, "start " + long[size - 200:size + 300]), (7, long[:70] + other + long[-500:]), (8, "x" + long[1:]), (9, long[size - 20:size + 29])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collected(suffixes.dedup_digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute_repeats(rows), key=repr)


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(4)
    for alphabet in (1, 2, 3, 200):
        s = rng.integers(0, alphabet, 500).astype(np.uint8)
        raw = s.tobytes()
        places = suffixes.suffix_array(s)
        assert sorted(places) == list(range(500))
        heads = [raw[p:p + 50] for p in places]
        assert all(a <= b for a, b in zip(heads, heads[1:]))


def test_repeats_are_cut_from_the_text(docs):
    cut = suffixes.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    expect = {(r[0], r[1]): e[1] - e[2] for r, e in zip(corpus(), brute_repeats(corpus()))}
    sizes = sorted(n for (d, t), n in expect.items() if t is not None and "é" not in t)
    got = {(r.doc_id, r.text) for r in cut.collect() if r.text is not None and "é" not in r.text}
    assert sorted(len(t.encode()) for _, t in got) == sizes
    assert all(r.text is None or r.n_chars == len(r.text) for r in cut.collect())


# ---- op9

def test_urls_given_rules_and_mined_verdicts(spark):
    urls = ["http://www.Example.ORG/es/1", "http://example.org/en/12?x", "http://a.org/x", "https://b.com/fr/", "https://b.com/de/1", "http://com/de/", "http://notexample.org/es/",
            "http://org", "no scheme/at.org/", None, "http://x.net/de/5", "http://x.net?q#/a", "://h/p", "http://u:p@Q.com:80/fr/x", "http://a.org#f", "http://example.org/es", ""]
    rows = [(k, u, None) for k, u in enumerate(urls)] + [(None, "http://a.org/x", None)]
    rows += [(1000 + k, f"http://h{k % 9}.com/{'de' if k % 2 else 'fr'}/{k}", None) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    out = urlrules.judge_urls(df).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, None
        rest = u.split("://", 1)[1]
        h = re.match(r"[^/?#]*", rest)[0]
        p = re.match(r"[^?#]*", rest[len(h):])[0]
        h = h.translate(LOW)
        fits = [(len(a + b), a + b, v) for a, b, v in urlrules.GIVEN if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return (h, p, *(max(fits)[1:] if fits else (None, None)))
    for k, u in enumerate(urls):
        h, p, rule, verdict = brute(u)
        assert (got[k].host, got[k].path, got[k].rule) == (h, p, rule), u
        assert verdict is None or got[k].verdict == verdict
    assert got[10].verdict == "block" and got[10].mined == "path=de"  # learned from com/de/
    assert {r.verdict for r in out} <= {"allow", "block"}
    assert urlrules.judge_urls(df.limit(0)).count() == 0
    unlabelled = urlrules.judge_urls(df.where("page_id in (9, 10, 11)")).collect()
    assert {r.verdict for r in unlabelled} == {"allow"}
