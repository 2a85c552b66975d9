"""The ten operators on small frames: brute force, edge cases, reruns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake.llm import ann, jaccard, langid, linedup, mixing, sharding, tokens, toxicity
from postlake.llm.common import components
from postlake.llm.decontam import benchmark_hits, drop_contaminated, near_matches
from postlake.llm.license import scan_licenses
from postlake.llm.linedup import drop_template_lines
from postlake.llm.substring import drop_repeated_spans, inner_arcs, paths, repeated_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
rng = np.random.default_rng(7)
WORDS = ["the", "Of", "naïve", "x1", "über", "and", "café", "to", "2024", "z"]
PASSAGE = " ".join(f"p{i}" for i in range(60))
LONG = " ".join(rng.choice(WORDS, 30_000).tolist())


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def edge_rows():
    """(doc_id, text, lang, source): nulls anywhere, empty and long texts, copies, near copies, a repeated row and a repeated id."""
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w77 ", "v77 ")
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, near, None, "b"), (4, None, "de", "b"), (5, "", "fr", None), (6, "  \t\n ", "fr", None), (None, base, "en", "a"), (8, f"{PASSAGE} tail", "en", "c"), (9, f"head {PASSAGE} x", "en", "c")]
    rows += [(10, LONG, "en", "a"), (11, "the " * 3000, "en", "a"), (11, "the " * 3000, "en", "a"), (12, "one", "en", "a"), (12, "other words here", "de", "b"), (13, "one", "en", "a"), (14, "a\vb\fc\rd", "en", "a")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """The edge rows with columns whose names the operators use inside."""
    frame = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string")
    extra = {name: F.lit(i) for i, name in enumerate(("k", "h", "n", "ord", "places", "score", "_row", "shard", "block", "c", "part"))}
    return frame.withColumns(extra)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ordered():
    """Rows as the operators order them: null id first, the same row once."""
    return sorted(set((i, t) for i, t, *_ in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))


def removed_words(rows, size=20):
    seen, out = {}, {}
    for row in rows:
        words = WORD.findall(row[1] or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen[key] = True
        out[row] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def test_words_and_hashes():
    texts = ["Ab  cd\n", "", "é ß", "x" * 40 + " y", None, "a\vb\x1fc", "ab CD ab"]
    words = tokens.Words(pa.array(texts), tokens.SPACED, spans=True)
    assert words.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    data, _ = tokens.text_bytes(pa.array(texts))
    assert [bytes(data[a:b]).decode() for a, b in zip(words.starts, words.ends)] == [w for t in texts for w in WORD.findall(t or "")]
    lower = tokens.Words(pa.array(["AB ab", "ab"]), tokens.SPACED_FOLDED).hashes
    assert len(set(lower.tolist())) == 1
    long = tokens.Words(pa.array([LONG * 20]), tokens.SPACED)
    assert long.counts[0] == len(WORD.findall(LONG * 20)) and len(set(long.hashes.tolist())) == len(set(WORD.findall(LONG * 20)))


def test_substring_dedup(spark, docs, none):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in drop_repeated_spans(docs).collect())
    wanted = removed_words(ordered())
    assert got == Counter((i, *wanted[i, t]) for i, t, *_ in edge_rows())
    spans = {r["doc_id"]: r["spans"] for r in drop_repeated_spans(docs.where("doc_id in (8, 9)")).collect()}
    assert spans[8] == [] and [tuple(s) for s in spans[9]] == [(1, 59)]
    assert drop_repeated_spans(none).count() == 0


def test_substring_dedup_on_random_text(spark):
    texts = [" ".join(rng.choice(["a", "b"], 60).tolist()) for _ in range(20)] + [" ".join(rng.choice(WORDS, 80).tolist()) for _ in range(10)]
    texts += [texts[3] + " " + texts[25], texts[25][5:]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), window=8, k=3).collect()}
    assert got == {row[0]: v for row, v in removed_words(rows, 8).items()}


def brute_components(rows, n, percent):
    sets = {}
    for key, text in rows:
        words = WORD.findall(folded(text))
        sets[key] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    parent, degree = {k: k for k in sets}, Counter()

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
                degree.update((a, b))
    return {k: (len(sets[k]), root(k), degree[k]) for k in sets}


@pytest.mark.parametrize(("block", "listed", "salted"), [(1024, 64, 8), (4, 64, 2), (1024, 2, 2), (4, 2, 8)])
def test_jaccard_join(spark, monkeypatch, block, listed, salted):
    """Chains of near copies, so that components reach beyond direct links: by listed pairs, in one block and in several, from salted buckets and others."""
    rng = np.random.default_rng(21)
    monkeypatch.setattr(jaccard, "_BLOCK", block)
    monkeypatch.setattr(jaccard, "_LISTED", listed)
    monkeypatch.setattr(jaccard, "_SALTED", salted)
    rows, text = [], [f"t{i}" for i in range(150)]
    for i in range(24):
        text = list(text)
        text[rng.integers(150)] = f"new{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(rng.choice(WORDS, 9).tolist())) for i in range(12)] + [(200, "a b c"), (201, "A b C"), (202, ""), (203, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_jaccard_edges(docs, none):
    rows = jaccard.jaccard_components(docs, 5, 80).collect()
    found = defaultdict(set)
    for r in rows:
        found[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert len(rows) == len(edge_rows())
    assert found[1] == found[2] == found[None] == {(196, None)} and found[3] == {(196, None)}
    assert found[4] == {(0, 4)} and found[5] == {(0, 5)} and found[13] == {(1, 12)}
    assert jaccard.jaccard_components(none).count() == 0
    kept = Counter(r["doc_id"] for r in jaccard.one_of_each(docs).collect())
    assert kept == Counter([None, 4, 5, 6, 8, 10, 11, 12, 12, 14]) and jaccard.one_of_each(docs).columns == docs.columns
    assert jaccard.one_of_each(none).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(23)
    for size in [1, 5, 64, 300]:
        for kept in range(0, size + 1, max(1, size // 20)):
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            y = np.unique(np.concatenate((x[:kept], rng.integers(0, 1 << 63, int(rng.integers(1, 2 * size + 1))).astype(np.uint64))))
            given = [(len(v), jaccard.bitmap(v).tobytes()) for v in (x, y)]
            wanted = bool(jaccard.linked(len(np.intersect1d(x, y)), len(x), len(y), 80))
            assert jaccard.overlap(x.tobytes(), y.tobytes(), 80) == wanted and jaccard.may_overlap(*given[0], *given[1], 80) >= wanted


def test_parts_of_linked_sets_meet():
    """The pigeonhole bound: every linked pair shares a tile, whatever tiles go as the most frequent ones."""
    rng, bands = np.random.default_rng(22), jaccard.Bands(85)

    def keys(members):
        sets = jaccard.Sets.__new__(jaccard.Sets)
        sets.members, sets.mixed, sets.row = members, tokens.mix(members), np.zeros(len(members), np.int64)
        sets.first, sets.sizes = np.array([0, len(members)]), np.array([len(members)])
        return {k for found, _, spare in jaccard.tiles(sets, np.array([True]), bands) for k in np.sort(found)[spare[0] :].tolist()}

    for size in [*range(1, 40), 100, 333]:
        x = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        for add in range(0, size + 1):
            most = next((d for d in range(size, -1, -1) if 100 * (size - d) >= 85 * (size + add)), None)
            if most is None:
                break
            y = np.unique(np.concatenate((x[most:], rng.integers(1 << 62, 1 << 63, add).astype(np.uint64))))
            assert keys(x) & keys(y)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


def by_hand_targets(sizes):
    free, left, out = dict.fromkeys(sizes), 1.5 * sum(sizes.values()), {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.pop(s)
    return out


def test_mixing(spark, docs, none):
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{i % 7}" if i % 7 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(frame).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    wanted = by_hand_targets({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))})
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(wanted[r["source"]]) and 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["size"] * r["copies"]
    assert all(abs(taken[s] - wanted[s]) <= 2 for s in sizes)
    again = mixing.mix_sources(frame.repartition(5)).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}
    same = mixing.mix_sources(frame.where("doc_id < 40").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("source", F.lit("s"))).collect()
    assert len(same) == 2000 and {r["copies"] for r in same} <= {1, 2} and abs(sum(r["size"] * r["copies"] for r in same) - same[0]["target"]) <= 60
    edge = mixing.mix_sources(docs).collect()
    assert len(edge) == len(edge_rows()) and mixing.mix_sources(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in edge)
    assert mixing.mixed_documents(none).count() == 0


def test_walk_keeps_totals():
    sizes, x = rng.integers(1, 100, 500).tolist(), rng.random(500).tolist()
    out = mixing.walk(sizes, x, rng.random(500).tolist())
    assert sum(0 < v < 1 for v in out) <= 2
    assert sum(out) == pytest.approx(sum(x)) and np.dot(sizes, out) == pytest.approx(np.dot(sizes, x))
    assert set(mixing.land(sizes, out, rng.random(500).tolist())) <= {0.0, 1.0}
    assert mixing.walk([5, 5, 5], [0.5, 0.5, 0.5], [0.1] * 3).count(0.5) <= 2


def test_sharding(spark, docs, none):
    frame = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), "id").alias("text"))
    rows = sharding.shard_documents(frame).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) < 1.25 * 500
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {16} and 0.7 < len(moved) / (8000 / 17) < 1.3
    assert all(r["text_crc32"] == zlib.crc32(f"é{r['doc_id']}".encode()) and r["size"] == len(f"é{r['doc_id']}".encode()) + 1 for r in rows)
    heavier = [(*x[:3], 3.0 if x[2] == 5 else 1.0) for x in sharding.even_tree()]
    other = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(frame, heavier).collect()}
    assert all(other[r["doc_id"]] // 8 == 0 for r in rows if r["shard"] != other[r["doc_id"]])  # into the changed region only
    edge = sharding.shard_documents(docs).collect()
    assert len(edge) == len(edge_rows()) and [r["size"] for r in edge if r["doc_id"] == 4] == [1] and sharding.shard_documents(none).count() == 0


def test_toxic_segments():
    def brute(scores):
        """Split off the best run, then treat what is left of it and right of it alike."""
        if not len(scores) or max(scores) <= 0:
            return []
        s, e = max(((i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda r: (round(sum(scores[r[0] : r[1]]), 9), r[0] - r[1]))
        return brute(scores[:s]) + [sum(scores[s:e])] + brute(scores[e:])

    for _ in range(60):
        scores = np.round(rng.normal(-0.3, 1, 12), 3)
        found = toxicity.segments(scores)
        assert [pytest.approx(s) for _, _, s in found] == brute(scores.tolist())
        assert all(scores[a : a + n].sum() == pytest.approx(s) for a, n, s in found)


def test_toxicity(spark, docs, none):
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "vilest", "awful"]
    rows, labels = [], []
    for i in range(500):
        words = rng.choice(plain, rng.integers(20, 200)).tolist()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(int(rng.integers(len(words))), str(rng.choice(bad)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, marks.where("doc_id < 350"))
    got = {r["doc_id"]: r for r in toxicity.toxic_passages(frame, model).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(t) for i, t in labels if i >= 350)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[400]["passages"] and not got[401]["passages"]
    kept = toxicity.drop_toxic(frame, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["score"] < 0.5}
    edge = toxicity.toxic_passages(docs, model).collect()
    assert len(edge) == len(edge_rows()) and toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.toxic_passages(none, model).count() == toxicity.drop_toxic(none, model).count() == 0
    blank = toxicity.fit(frame, marks.limit(0))
    assert {r["score"] for r in toxicity.toxic_passages(docs, blank).collect()} == {0.5}


def test_language(spark, docs, none):
    stems = {"aa": "xyz", "bb": "klm", "cc": "opq"}
    texts = [(i, " ".join("".join(rng.choice(list(stems[lang]), 5)) for _ in range(20)), lang) for i, lang in enumerate(list(stems) * 60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    net = langid.fit(frame.where("doc_id < 120"), epochs=12, size=4)
    got = langid.detect_languages(frame.where("doc_id >= 120"), net).collect()
    wanted = {i: lang for i, _, lang in texts}
    assert np.mean([wanted[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    edge = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.detect_languages(docs, net).collect()}
    assert {(4, "und", 0.0), (5, "und", 0.0), (6, "und", 0.0)} <= edge
    assert langid.detect_languages(none, net).count() == 0 and langid.fit(none) is None
    assert {r["lang_pred"] for r in langid.detect_languages(docs, None).collect()} == {"und"}


def test_network_gradients_and_pooling():
    net = langid.new_network(["a", "b", "c"], 3, 1)
    runs, inside = langid._runs_of([b"hello wor", b"abc", b"xyzw"])
    labels = np.array([0, 2, 1])
    _, gradients = langid.loss_and_gradients(net, runs, inside, labels)
    for w, g in zip(net.weights(), gradients):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, step = w[at], 1e-2
        w[at] = before + step
        high, _ = langid.loss_and_gradients(net, runs, inside, labels)
        w[at] = before - step
        low, _ = langid.loss_and_gradients(net, runs, inside, labels)
        w[at] = before
        assert (high - low) / (2 * step) == pytest.approx(g[at], rel=0.02, abs=1e-4)
    probs, _ = langid.position_probabilities(net, runs, inside)
    assert np.allclose((probs * inside[:, :, None]).sum(0), langid.pooled(net, runs, inside), atol=1e-4)
    text = pa.array(["é" * 100, "", None, "short"])
    assert langid.document_probabilities(net, text).sum(1).tolist() == pytest.approx([1, 0, 0, 1], abs=1e-4)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_line_dedup(spark, docs, none, monkeypatch, few):
    """With broadcast places and with shuffled texts."""
    monkeypatch.setattr(linedup, "FEW_PLACES", few)
    rows = [(1, "Report 17 of the day\nunique one here"), (2, "Report 18 of the day\nsomething else"), (3, "report\nReport 19 of the day"), (4, "Report of\n\nother"), (5, None), (6, "")]
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in drop_template_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 2, 0), 2: ("something else", 2, 1), 3: ("report", 2, 1), 4: (rows[3][1], 3, 0), 5: (None, 0, 0), 6: ("", 1, 0)}
    names = [(i, f"From {n} to {m} by the evening mail") for i, (n, m) in enumerate([("Ann", "Bob"), ("Cid", "Dan"), ("Eve", "Fay"), ("Gus", "Hal")])]
    fields = {r["doc_id"]: r["n_dropped"] for r in drop_template_lines(spark.createDataFrame(names, "doc_id long, text string"), depth=1).collect()}
    assert fields == {0: 0, 1: 1, 2: 1, 3: 1}
    long = "\n".join(["Report 20 of the day", *[f"line number {i} is mine" for i in range(5000)], *["a b\tc"] * 300])
    rows += [(7, long), (7, long), (8, "Report 1 of the day"), (None, "Report 2 of the day\na b c\n"), (None, "Report 3 of the day"), (9, "Report 1 of the day\nReport 1 of the day\na b c")]
    got = Counter((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in drop_template_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    wanted = Counter({(1, "unique one here", 2, 1): 1, (2, "something else", 2, 1): 1, (3, "report", 2, 1): 1, (4, rows[3][1], 3, 0): 1, (5, None, 0, 0): 1, (6, "", 1, 0): 1, (8, "", 1, 1): 1, (9, "", 3, 3): 1})
    kept = "\n".join(f"line number {i} is mine" for i in range(5000))
    first, second = sorted((rows[-3][1], rows[-2][1]), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    lines = {rows[-3][1]: "a b c\n", rows[-2][1]: ""}
    assert got[7, kept, 5301, 301] == 2
    assert {k: v for k, v in got.items() if k[0] not in (7, None)} == dict(wanted)
    assert got[None, first, first.count("\n") + 1, 0] == 1 and got[None, lines[second], second.count("\n") + 1, 1] == 1
    assert drop_template_lines(docs).count() == len(edge_rows()) and drop_template_lines(none).count() == 0


def brute_hits(text, items, size=13):
    words, hit, found = ALNUM.findall(folded(text)), set(), set()
    for item, other in items:
        terms = ALNUM.findall(folded(other))
        for j in range(max(1, len(terms) - size + 1) if terms else 0):
            window = terms[j : j + size]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, docs, none):
    items = [(1, PASSAGE), (2, "one"), (10, PASSAGE[:80]), (3, None), (4, "..."), (5, "of x1 Naïve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in benchmark_hits(docs, bench).collect())
    wanted = Counter()
    for i, text, *_ in edge_rows():
        n, hit, names = brute_hits(text, items)
        wanted[(i, n, hit, tuple(names), hit > 0 and 20 * hit >= n)] += 1
    assert got == wanted
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for (*_, bad), n in wanted.items() if not bad)
    assert benchmark_hits(none, bench).count() == 0 and not any(r["contaminated"] for r in benchmark_hits(docs, bench.limit(0)).collect())
    near = {(r["doc_id"], r["item_id"]) for r in near_matches(docs, spark.createDataFrame([("p", "p5 p1 p3 p9 p2")], "item_id string, text string"), within=10).collect()}
    assert near == {(8, "p"), (9, "p")}


def test_license_scan(spark, docs, none):
    rows = [(1, "RELEASED under the M.I.T Licence!"), (2, "Copyright 2020 A\nReleased under the MIT licence."), (3, "text\nLicensed under CC BY-NC 4.0.\nmore\nLicensed under CC BY-NC 4.0."), (4, None), (5, "")]
    got = {r["doc_id"]: (r["license"], list(r["licenses"]), r["n_license_lines"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (None, [], 0), 2: ("MIT", ["MIT"], 1), 3: (None, ["CC-BY-NC-4.0"], 2), 4: (None, [], 0), 5: (None, [], 0)}
    assert scan_licenses(docs).count() == len(edge_rows()) and scan_licenses(none).count() == 0
    known = spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(), "own")], "digest string, license string")
    assert {r["doc_id"] for r in scan_licenses(docs, known).collect() if r["license"]} == {12, 13}


def test_nearest_neighbours(spark):
    x = np.random.default_rng(5).normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[500]  # a bunch of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (None, [1.0] * 16), (5004, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(frame, frame.where("vec_id % 60 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    wide, right = x.astype(float), 0
    assert set(got) == set(range(0, 3000, 60))
    for q, found in got.items():
        scores = wide @ wide[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -scores))[:10]
        right += len(set(best.tolist()) & {v for v, _ in found})
        assert [v for v, _ in found] == [v for v, _ in sorted(found, key=lambda f: (-f[1], f[0]))]
        assert all(s == pytest.approx(scores[v]) for v, s in found)
    assert right >= 0.9 * 10 * len(got)
    copies = wide @ wide[540]
    copies[540] = -np.inf
    assert [v for v, _ in got[540]] == np.lexsort((np.arange(3000), -copies.round(9)))[:10].tolist()  # ties go to smaller ids
    few = ann.nearest(frame.where("vec_id < 3"), frame.where("vec_id < 3"), k=10).collect()
    assert Counter(r["query_id"] for r in few) == {0: 2, 1: 2, 2: 2}
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_nearest_neighbours_of_single_vectors_among_copies(spark):
    own = np.random.default_rng(3)
    x = np.concatenate([np.repeat(own.normal(size=(40, 16)), 60, axis=0), own.normal(size=(60, 16))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    single = frame.where("vec_id >= 2400 OR vec_id % 60 = 0")
    for probes in (None, 1):
        got = defaultdict(list)
        for r in ann.nearest(frame, single, k=20, probes=probes).collect():
            got[r["query_id"]].append(r["score"])
        assert set(got) == {*range(0, 2400, 60), *range(2400, 2460)} and {len(v) for v in got.values()} == {20}
        wide = x.astype(float)
        for q, found in got.items() if probes is None else ():
            scores = np.delete(wide @ wide[q], q)
            assert sum(s >= np.sort(scores)[-20] - 1e-6 for s in found) >= 18


def test_nearest_neighbours_in_blocks_of_vectors_and_queries(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(600, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    wanted = sorted(ann.nearest(frame, frame, k=3).collect())
    scores = ann._scores

    def bounded(*given):
        run = scores(*given)

        def checked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            assert max(len(left), len(right)) <= 2 * 100
            return run(left, right)

        return checked

    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "_scores", bounded)
    assert sorted(ann.nearest(frame, frame, k=3).collect()) == wanted and len(wanted) == 3 * 600


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_license_scan_of_whole_texts_and_runs(spark):
    code = "import x\n" + "\n".join(f"# {line}" for line in MIT.split("\n")) + "\nprint(x)"
    cut = MIT.replace("free of charge", "for a charge")
    rows = [(1, f"MIT License\n\nCopyright (c) 2020 A\n\n{MIT}"), (2, code), (3, cut), (4, "a\nReleased under\nthe MIT License. b"), (5, "This is licensed under CC BY 4.0. Fine."), (6, "Released under the MIT"), (7, MIT.replace("\n", " "))]
    frame = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string")
    wanted = {1: ("MIT", ["MIT"], 16), 2: (None, ["MIT"], 15), 3: (None, [], 0), 4: (None, ["MIT"], 2), 5: (None, ["CC-BY-4.0"], 1), 6: (None, [], 0), 7: ("MIT", ["MIT"], 1)}
    found = [(r["doc_id"], (r["license"], list(r["licenses"]), r["n_license_lines"])) for r in scan_licenses(frame).collect()]
    assert dict(found) == wanted and len(found) == 8


def test_paths_end_where_occurrences_differ(spark):
    vertices = [(1, 1, 5, 3, 2, 10, 1 << 31), (2, 1, 8, 2, 2, 1 << 31, 30), (3, 1, 10, 4, 2, 31, 40), (4, 1, 14, 1, 3, 40, 50), (5, 2, 0, 1, 2, 1, 7), (6, 2, 2, 1, 2, 7, 2)]
    live = spark.createDataFrame([(m, (k, at), n, c, (s << 32 | e) - (1 << 64 if s >> 31 else 0)) for m, k, at, n, c, s, e in vertices], "m long, f struct<k:long,at:long>, n long, c long, sums long")
    assert [r["m"] for r in inner_arcs(live).collect()] == [2]
    at = lambda order, word: (order << 40) + word
    rows = [(k, at(o, w), n, opens) for k, o in ((1, 0), (2, 0), (2, 1)) for w, n, opens in ((5, 3, True), (8, 2, False), (10, 4, True), (20, 1, False))] + [(1, at(0, 5), 3, True), (1, at(0, 8), 2, False)] * 20
    got = set(map(tuple, paths(spark.createDataFrame(rows, "k long, at long, n long, opens boolean")).collect()))
    wanted = {(k, at(o, w), n) for k, o in ((1, 0), (2, 0), (2, 1)) for w, n in ((5, 5), (10, 4), (20, 1))}
    assert wanted <= got <= wanted | {(1, 5, 3)}


def test_substring_dedup_of_many_rows_without_id(spark):
    rows = [(None, f"{i} " + " ".join(WORDS[j % len(WORDS)] + str(j) for j in range(30))) for i in range(300)] + [(7, "a " * 40)] * 300
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(None, 31, 30): 299, (None, 31, 0): 1, (7, 40, 39): 300}


def test_line_dedup_of_long_words(spark):
    """A word of 200,000 letters, one with a digit at its end, and one with digits all over take no time to speak of."""
    import time

    from postlake.llm.linedup import drop_template_lines

    rows = [(1, "a" * 200_000), (2, "b" * 200_000 + "7"), (3, "1x" * 100_000 + "\nplain line"), (4, "x7y <*> a1"), (5, "漢" * 100_000)]
    began = time.time()
    got = {r["doc_id"]: r["n_lines"] for r in drop_template_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1} and time.time() - began < 60


def test_masks_are_those_of_whole_words(spark):
    from postlake.llm.linedup import masked_lines

    text = "abc 4 x7y  7 a-1-b\tno\n9\n 漢字2 end"
    assert spark.createDataFrame([(text,)], "t string").select(masked_lines(F.col("t"))).first()[0] == ["abc <*> <*> <*> <*> no", "<*>", "<*> end"]


def test_double_and_whole_vectors(spark):
    """Vectors of doubles and of integers are searched and scored as they are."""
    import numpy as np

    from postlake.llm.ann import nearest

    x = np.random.default_rng(3).normal(size=(120, 8))
    frame = spark.createDataFrame([(i, [float(v) for v in row], "c", 1.0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, cell string, v double")
    got = nearest(frame, frame.where("vec_id % 20 = 0"), k=5).collect()
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert len(got) == 30 and all(abs(s - float((x[q] * x[i]).sum())) < 1e-12 for (q, i), s in scores.items())
    whole = frame.selectExpr("vec_id", "transform(embedding, e -> CAST(round(e * 9) AS INT)) AS embedding")
    assert len(nearest(whole, whole.where("vec_id = 0"), k=3).collect()) == 3


def test_decontamination_of_many_rows_without_an_id(spark, monkeypatch):
    """600 different texts without an id, each with a hit of its own, and terms in several passes."""
    from postlake.llm import decontam

    monkeypatch.setattr(decontam, "TERMS_A_PASS", 40)
    words = [" ".join(f"w{i}x{j}" for j in range(14)) for i in range(30)]
    items = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], "item_id string, text string")
    docs = spark.createDataFrame([(None if i % 2 else 7, f"t{i} {words[i % 30]} end") for i in range(600)], "doc_id long, text string")
    got = decontam.benchmark_hits(docs, items).collect()
    assert len(got) == 600 and all(r["n_hit"] == 14 and len(r["items"]) == 1 and r["contaminated"] for r in got)
    near = decontam.near_matches(docs.where("doc_id = 7").limit(60), items, within=20, terms=3).collect()
    assert {r["item_id"] for r in near} <= {str(i) for i in range(30)} and near


def test_texts_are_not_shuffled_beside_spans(spark):
    """What the spans are read from holds neither texts nor edges on their way: those are written before."""
    docs = spark.createDataFrame([(i, f"{i} " + " ".join(f"w{j}" for j in range(60)) + f" end{i}") for i in range(5)], "k long, text string").withColumn("ord", F.lit(0).cast("long"))
    spans = repeated_spans(docs, docs.repartition("k", "ord"), 20, 5)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "w1" not in plan
    assert {r["k"] for r in spans.collect()} == {1, 2, 3, 4}
