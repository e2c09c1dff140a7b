"""Every query of the subpackage against SQL, brute force, an exact round trip or held-out labels."""

import collections
import hashlib
import html
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import check, connect
from colloquy.llm import decontaminate, queries


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in docs.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    same, mine, theirs, drift, _, _ = check(spark, connect(sf), name, queries.QUERIES[name], queries.SQL[name], sf)
    assert same and not drift, (mine[0], theirs[0], drift)


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_neighbours_reach_the_recall(spark, sf):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    names = np.array(sorted(rows))
    m = np.stack([rows[k] for k in names])
    found = collections.defaultdict(list)
    for r in run(spark, sf, "op1_neighbours"):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {k for k in rows if k % 20 == 0}
    hits = total = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and q not in {g[1] for g in got}
        assert all(abs(s - rows[q] @ rows[v]) < 1e-12 for _, v, s in got)
        scores = m @ rows[q]
        order = [v for v in names[np.lexsort((names, -scores))].tolist() if v != q][:20]
        hits, total = hits + len(set(order) & {g[1] for g in got}), total + 20
    assert hits / total >= 0.9


def test_packing(spark, sf, ids):
    rows = run(spark, sf, "op2_pack")
    packed(rows, ids)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(map(len, ids.values())) // 4096) + 1


def packed(rows, ids):
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    bins = collections.defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(piece) == r["length"] and crc(piece) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096


def test_toxicity_of_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = run(spark, sf, "op3_toxicity")
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([p == t for p, t in held]) > 0.93 and sum(p and not t for p, t in held) <= 2


def test_token_file_round_trip(spark, sf, ids):
    at, want = 0, {}
    for k in sorted(ids):
        want[k] = (at, len(ids[k]), crc(ids[k]))
        at += len(ids[k])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, sf, "op5_token_file")} == want


def words(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def test_decontamination_finds_every_passage(spark, sf, docs):
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(k, i) for k, t in docs.items() for i, w in items.items() if w in words(t)}
    found = run(spark, sf, "op6_decontaminate")
    assert exact <= {(r["doc_id"], r["item_id"]) for r in found} and exact
    for r in found:
        item = words(next(t for i, t in items.items() if i == r["item_id"])).split()
        passage = words(docs[r["doc_id"]]).split()[r["start"]:r["start"] + r["words"]]
        d = np.arange(len(passage) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(passage, 1):
                new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
            d = new
        assert d[-1] == r["edits"] <= decontaminate.DISTANCE * len(item)


def test_main_text(spark, sf):
    got = {r["page_id"]: r for r in run(spark, sf, "op7_main_text")}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)


def test_language_of_held_out_rows(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = run(spark, sf, "op9_language")
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95


def groups(docs, words=5, percent=75):
    """doc_id to (shingles, component) by comparing all pairs that share a shingle."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in docs.items():
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[k] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    posted = collections.defaultdict(list)
    for k, s in sets.items():
        for g in s:
            posted[g].append(k)
    common = collections.Counter((a, b) for p in posted.values() for i, a in enumerate(p) for b in p[i + 1:])
    root = {k: k for k in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {k: (len(sets[k]), top(k)) for k in docs}


def test_near_duplicates(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, sf, "op10_near_dups")}
    assert got == {k: (n, c, k == c) for k, (n, c) in groups(docs).items()}


def test_pipeline(spark, sf, docs, ids):
    """Stage by stage from the operators' own queries where a stage's input is the whole table, then by brute force."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    langs = corpus_pipeline.language(spark, table, sf)
    assert langs.columns == table.columns
    kept = {r["doc_id"] for r in langs.collect()}
    assert kept == {r["doc_id"] for r in run(spark, sf, "op9_language") if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_SHARE}
    calm = {r["doc_id"] for r in corpus_pipeline.clean_language(spark, langs, sf).collect()}
    one_each = {k for k, (_, c) in groups({k: docs[k] for k in calm}).items() if k == c}
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {k for k in one_each if not any(w in words(docs[k]) for w in items)}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == left
    packed(rows, {k: ids[k] for k in left})


def test_chat_digest_by_hand(spark, sf):
    rows = {r["conv_id"]: r for r in run(spark, sf, "op4_chat")}
    text = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert rows[-1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and rows[-1]["loss_chars"] == len(text)
