"""Token alignment, source divergence and byte dedup against brute force, and their rows at the edges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL

from postlake.llm.divergence import source_divergence, term_counts
from postlake.llm.queries import queries
from postlake.llm.tokenalign import BYTE_BPE, PIECE_BPE, align_tokenizers, common_ends


def brute_alignment(texts):
    """The contract of op12 by the tokenizer libraries and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    back = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    back.update({chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)})
    docs, corpus = [], Counter()
    for text in texts:
        wanted = (" " + (text or "")).encode()
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(bytes_a) != wanted or b"".join(bytes_b) != wanted:
            docs.append(([], [], []))
            continue
        groups, ga, gb, at_a, at_b, j = [], [], [], 0, 0, 0
        for i, x in enumerate(ia):
            at_a += len(bytes_a[i])
            ga.append(x)
            while j < len(ib) and at_b + len(bytes_b[j]) <= at_a:
                at_b += len(bytes_b[j])
                gb.append(ib[j])
                j += 1
            if at_a == at_b:
                groups.append((ga, gb))
                ga, gb = [], []
            elif j < len(ib) and at_b + len(bytes_b[j]) <= at_a:
                raise AssertionError
        docs.append((ia, ib, groups))
        corpus.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in corpus.items():
        best[x] = max(best[x], n)
    out = []
    for ia, ib, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        spelt = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((len(ia), len(ib), len(groups), len(links), sum(corpus[x] == best[x[0]] for x in links), sum(corpus[x] for x in links), hashlib.sha256(spelt.encode()).hexdigest() if ia else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op12_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    wanted = {d["doc_id"]: row for d, row in zip(docs, brute_alignment([d["text"] for d in docs]), strict=True)}
    got = queries()["op12_token_alignment"](spark, SMALL).collect()
    assert len(got) == len(docs) and sum(row[0] > 0 for row in wanted.values()) > 100
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == wanted


def test_alignment_edges(spark):
    """Null, empty, repeated, changed, very long and special texts; null and repeated ids; clashing columns; no rows."""
    texts = [None, "", "  two  spaces ", "<|endoftext|> <s> </s> <0x41>", "a▁b", "日本語 \U0001f600 é", "x" * 5000, "ab " * 30000, "same text", "same text", "\x00\x01 \t\n 　", " lead", "don't 'll 12345"]
    rows = [(None if i % 3 == 0 else 7, t, i, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pairs int, row string")
    got = align_tokenizers(frame).collect()
    wanted = brute_alignment(texts)
    assert sorted((r["doc_id"] or -1, *(r[c] for c in COLUMNS)) for r in got) == sorted((r[0] or -1, *w) for r, w in zip(rows, wanted, strict=True))
    assert align_tokenizers(frame.limit(0)).collect() == []


@pytest.mark.parametrize("a, b", [([1, 2, 3], [3]), ([5], [1, 2, 3, 4, 5]), (list(range(0, 400, 7)), list(range(0, 400))), ([], [1]), ([2, 4, 400], list(range(3, 401)))])
def test_galloping(a, b):
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    at_a, at_b = common_ends(a, b)
    both = sorted(set(a.tolist()) & set(b.tolist()))
    assert [a[i] for i in at_a] == both and [b[i] for i in at_b] == both


def test_alignment_of_frequent_pairs_only_or_none(spark, monkeypatch):
    """Pairs that are broadcast and pairs that are shuffled give the same sums."""
    from postlake.llm import tokenalign

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    whole = sorted(map(tuple, align_tokenizers(docs).collect()))
    for part in (0, 50):
        monkeypatch.setattr(tokenalign, "_FREQUENT", part)
        assert sorted(map(tuple, align_tokenizers(docs).collect())) == whole


def test_divergence_edges(spark, tmp_path):
    """Null languages, sources and texts, a source without terms, ties, repeated rows, clashing columns: as the SQL has it."""
    import duckdb

    from postlake.llm.oracles import OP13

    rows = [(1, "Alpha beta, beta! x9y", "en", "a"), (1, "Alpha beta, beta! x9y", "en", "a"), (None, "alpha-alpha BETA Été", "en", "b"), (3, None, "en", "c"), (4, "", "en", None), (5, "beta beta alpha Été", "en", "b"), (6, "solo", "fr", "a"), (7, "x" * 100000 + " solo alpha", None, None), (8, "solo.solo", "fr", "b"), (9, "Été", "en", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS chunk", "2 AS term", "3 AS doc", "4 AS n")
    path = str(tmp_path / "documents.parquet")
    frame.coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{path}/*.parquet'")
    got = source_divergence(spark.read.parquet(path))
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == sorted(db.execute(OP13).fetchall())
    assert source_divergence(frame.limit(0)).collect() == []
    once = {(r["lang"], r["term"]) for r in term_counts(frame, 1).collect()}
    assert ("fr", "solo") in once and ("", "alpha") in once and ("en", "été") not in once
    with pytest.raises(ValueError):
        term_counts(frame, 4)


def test_divergence_in_blocks(spark, monkeypatch):
    """Blocks of a few terms give the sums of one block."""
    from postlake.llm import divergence

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = sorted(map(tuple, source_divergence(docs).collect()))
    monkeypatch.setattr(divergence, "_CELLS", 500)
    monkeypatch.setattr(divergence, "_FRESH", 30)
    monkeypatch.setattr(divergence, "_HELD", 50)
    assert sorted(map(tuple, source_divergence(docs).collect())) == whole


def brute_bytes(rows, window):
    """(id, text) rows to (kept, n_bytes, n_removed, spans) each."""
    datas = [(text or "").encode() for _, text in rows]
    key = lambda i: -1 if i is None else i
    first = {}
    for (i, _), data in zip(rows, datas, strict=True):
        for at in range(len(data) - window + 1):
            s = data[at : at + window]
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for (i, _), data in zip(rows, datas, strict=True):
        gone = [False] * len(data)
        for at in range(len(data) - window + 1):
            if first[data[at : at + window]] < key(i):
                gone[at : at + window] = [True] * window
        spans = []
        for at, x in enumerate(gone):
            if x and at and gone[at - 1]:
                spans[-1][1] += 1
            elif x:
                spans.append([at, 1])
        out.append((bytes(b for b, x in zip(data, gone, strict=True) if not x), len(data), sum(gone), [tuple(s) for s in spans]))
    return out


def byte_rows(frame, **options):
    from postlake.llm.suffixes import drop_earlier_bytes

    return [(r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]]) for r in drop_earlier_bytes(frame, **options).collect()]


@pytest.mark.parametrize("many, shard, slice_bytes", [(20_000, 4 << 20, 1 << 20), (1, 200, 97)])
def test_byte_dedup_equals_brute_force(spark, monkeypatch, many, shard, slice_bytes):
    """Null, empty, repeated, nested, periodic and long texts, ties of ids, clashing columns; also with tiny shards and slices and second minimizers."""
    import random

    from postlake.llm import suffixes

    monkeypatch.setattr(suffixes, "MANY_PIECES", many)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffixes, "_SLICE", slice_bytes)
    rng = random.Random(11)
    passages = ["".join(rng.choice("abé日 ") for _ in range(n)) for n in (20, 30, 45, 60, 90, 150)]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(8)))
        rows.append((rng.choice([None, i, i % 10, i]), text))
    rows += [(900, None), (901, ""), (902, "a" * 300), (903, "a" * 200), (904, "ab" * 400), (905, "ab" * 400), (905, "ab" * 400), (3, "a" * 60), (906, passages[5] * 3), (907, passages[5][1:120])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS m", "'x' AS places").repartition(5)
    wanted = [(i, *w) for (i, _), w in zip(rows, brute_bytes(rows, 30), strict=True)]
    assert sorted(map(repr, byte_rows(frame, window=30, gram=10))) == sorted(map(repr, wanted))
    assert sum(w[3] > 0 for w in wanted) > 50
    assert byte_rows(frame.limit(0)) == []


@pytest.mark.parametrize("memory", [4 << 20, 9])
def test_induced_sorting_equals_plain_sorting(memory, monkeypatch):
    """Random, repeated, constant and tiny texts, by bytes and by large symbols, with queues in memory and on disk."""
    import numpy as np

    from postlake.llm import induced

    rng = np.random.default_rng(5)
    for turn in range(150):
        n, top = int(rng.integers(1, 200)), int(rng.choice([1, 2, 4, 250, 3000]))
        text = rng.integers(1, top + 1, n)
        text = np.tile(text[: n // 4 + 1], 5) if turn % 4 == 0 else text
        text = np.append(text, 0).astype(np.uint16)
        monkeypatch.setattr(induced, "_RANGE", 6 if turn % 2 else 1 << 12)
        order, common = induced.suffix_order(text, 3001 if turn % 3 else int(text.max()) + 1, memory, 50)
        plain = text.tolist()
        wanted = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert induced.suffix_order(text, 3001, memory)[0].tolist() == wanted
        order_list = order.tolist()  # by 50 symbols, of more than these in any order
        assert sorted(order_list) == sorted(wanted) and [plain[i : i + 50] for i in order_list] == [plain[i : i + 50] for i in wanted]
        prefixes = [next((d for d in range(51) if d == 50 or plain[a + d] != plain[b + d]), 0) for a, b in zip(wanted, wanted[1:], strict=False)]
        assert common.tolist() == [0, *prefixes]
    spool = induced.Spool(3, 2, 4)
    for step in range(10):
        spool.put(np.array([step % 3] * 2), np.array([[step, step], [1, 2]]))
    assert spool.spilled and [spool.take(i)[0].tolist() for i in range(3)] == [[0, 0, 3, 3, 6, 6, 9, 9], [1, 1, 4, 4, 7, 7], [2, 2, 5, 5, 8, 8]]


def test_stretch_that_longer_ones_begin_with(spark):
    """A stretch of just the symbols compared at once is larger than all that begin with it; then equal bytes stand together."""
    import numpy as np

    from postlake.llm import induced

    head = [2, 4, 4, 4, 4, 4, 3]
    text = [5, *head, 5, *head, 1, 5, *head, 2, 5, 0]
    order, _ = induced.suffix_order(np.array(text, np.uint8), 256, most=50)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    words = ["bddddcebddddcaebddddcb", "bdddddce", "bdddddca", "bdddddcb"]
    rows = [(i, "".join(words[(i * k * k + k) % 4] for k in range(40))) for i in range(60)]
    got = byte_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(got) == [(i, *w) for (i, _), w in zip(rows, brute_bytes(rows, 50), strict=True)]


@pytest.mark.parametrize("second", [False, True])
def test_strings_of_one_piece_alone_are_not_sorted(monkeypatch, second):
    """Pieces that share a minimizer but no string stay out of the suffix order; all strings get their smallest document."""
    import random

    import pyarrow as pa

    from postlake.llm import suffixes

    rng = random.Random(3)
    noise = lambda n: bytes(rng.choice(b"abcdefghij ") for _ in range(n))
    phrase, tail = noise(24), noise(45)
    texts = [noise(60) + phrase + (tail if i % 20 == 0 else noise(60)) for i in range(80)]
    found = []
    for i, data in enumerate(texts):
        low, starts, n = suffixes.pieces(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 50, 12 if second else 20, salt=suffixes._SECOND if second else 0)
        for g, at, k in zip(low.view(np.int64).tolist(), starts.tolist(), n.tolist(), strict=True):
            m = 99 if second else g  # a second minimizer deals out the pieces of a first one, here 99
            found.append((g ^ 99 if second else g, m, len(found), i, i + 5 * (i % 3 == 0), 7, data[at : at + k + 49]))
    found.sort(key=lambda row: row[0])
    sizes = []
    plain = suffixes.suffix_order
    monkeypatch.setattr(suffixes, "suffix_order", lambda text, *rest: sizes.append(len(text)) or plain(text, *rest))
    columns = [np.array(c, np.int64) for c in zip(*(row[:6] for row in found), strict=True)]
    runs = suffixes.first_strings(*columns, pa.array([row[6] for row in found], pa.binary()), 50, 20)
    got = {}
    for _, u, off, n, lo in zip(*(c.tolist() for c in runs), strict=True):
        for at in range(off - 7, off - 7 + n):
            assert got.setdefault((u, at), lo) == lo
    least = {}
    strings = [(g, u, lo, hi, at, b[at : at + 50]) for g, _, u, lo, hi, _, b in found for at in range(len(b) - 49)]
    for g, _, lo, _, _, s in strings:
        least[g, s] = min(least.get((g, s), lo), lo)
    assert got == {(u, at): least[g, s] for g, u, _, hi, at, s in strings if least[g, s] < hi}
    assert any(least[g, s] < lo for g, _, lo, _, _, s in strings)
    assert 0 < sum(sizes) < sum(len(row[6]) for row in found) / 8


@pytest.mark.parametrize("limit, rows", [(16 << 20, 20_000), (3000, 7)])
def test_tasks_hand_on_terms_with_exact_documents(limit, rows):
    """What a task hands on are terms, one row each for a language and source it holds at once, with their documents and occurrences."""
    import re

    import pyarrow as pa
    import pyarrow.parquet as pq

    from postlake.llm import divergence

    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["lang", "source", "text"]).to_pylist()
    table = [{c: x or "" for c, x in row.items()} for row in table]
    table += [{"lang": "en", "source": "s", "text": t} for t in ("", " \t\n", "12 34!", "(Alpha alpha,beta ALPHA", "Été　x\x00Y[z`Kİ ", "alpha " * 2000)]
    n, n_docs = Counter(), Counter()
    for row in table:
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), row["text"])))
        for term, count in terms.items():
            n[row["lang"], row["source"], term] += count
            n_docs[row["lang"], row["source"], term] += 1
    handed = [r for batch in divergence._counts(limit, rows)(iter(pa.Table.from_pylist(table).to_batches(40))) for r in batch.to_pylist()]
    got, got_docs = Counter(), Counter()
    for r in handed:
        got[r["lang"], r["source"], r["term"]] += r["n"]
        got_docs[r["lang"], r["source"], r["term"]] += r["n_docs"]
    assert got == n and got_docs == n_docs
    assert (len(handed) == len(n)) == (limit > 3000)
