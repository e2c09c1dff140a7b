"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import (
    ann, chat_format, decontaminate, language_mix, near_dups, packing, page_template, token_codes, token_ids, toxicity, url_rules,
)

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string"
LONG = "word and other words, " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "same text here to repeat"), (5, "same text here to repeat"), (5, "same text here to repeat"),
            (None, "same text here to repeat"), (6, LONG), (7, "123 !!"), (8, "\u0130stanbul <|endoftext|> caf\u00e9 \u4f60\u597d")]
    return spark.createDataFrame([(k, t, "en" if t else None, None, 0, "own") for k, t in rows], DOC)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_tokens(spark, odd, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in token_ids.encode_documents(odd, keep=("doc_id", "score")).collect():
        assert r["score"] == "own"
    got = sorted((str(r["text"]), bytes(r["ids"])) for r in token_ids.encode_documents(odd.withColumn("t", F.col("text")), text="t", keep=("text",)).collect())
    want = sorted((str(r["text"]), np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in odd.collect())
    assert got == want
    path = str(tmp_path / "codes")
    token_codes.write_codes(odd, path, segment_tokens=50)
    segments = token_codes.read_codes(spark, path)
    stored = token_codes.stored_documents(segments).orderBy("start").collect()
    assert [r["doc_id"] for r in stored] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    flat = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in stored])
    assert [r["start"] for r in stored] == [0, *np.cumsum([len(r["ids"]) // 4 for r in stored])[:-1].tolist()]
    asked = [0, 7, len(flat) - 1, len(flat) // 2]
    found = token_codes.tokens_at(segments, spark.createDataFrame([(p,) for p in asked], "position long"))
    assert {r["position"]: r["token"] for r in found.collect()} == {p: int(flat[p]) for p in asked}
    token_codes.write_codes(none, str(tmp_path / "none"))
    assert token_codes.stored_documents(token_codes.read_codes(spark, str(tmp_path / "none"))).count() == 0


def test_image_of_wide_ids():
    ids = np.array([0, 255, 256, 65_535, 65_536, 2**24, 2**32 - 1, 5], np.uint32)
    image = token_codes.Image(token_codes.encode_image(np.array([3]), np.array([0, len(ids)]), ids))
    assert image.tokens(np.array([6, 0, 4, 4, 5, 1, 2, 3, 7])).tolist() == ids[[6, 0, 4, 4, 5, 1, 2, 3, 7]].tolist()


@pytest.mark.parametrize("lengths", [[], [5], [10] * 7, [6, 6, 6, 4, 4, 4], list(range(1, 10)) * 30])
def test_packing(spark, lengths):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "key long, length long")
    rows = packing.pack(df, "key", capacity=10, partition_pieces=8).collect()
    assert sorted(r["key"] for r in rows) == list(range(len(lengths)))
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + lengths[r["key"]]
    assert all(v <= 10 for v in bins.values())
    # a certified partition of pieces that fill their bins leaves less than one bin of room
    assert len(bins) <= -(-sum(lengths) // 10) + -(-len(lengths) // 8)
    if lengths:
        assert packing.bins_needed(*np.unique(lengths, return_counts=True), 10) <= len(bins)


def test_bound_is_tight():
    assert packing.bins_needed(np.array([6]), np.array([3]), 10) == 3
    assert packing.bins_needed(np.array([4, 6, 10]), np.array([3, 3, 2]), 10) == 5
    assert packing.bins_needed(np.array([34]), np.array([6]), 100) == 3


def test_packing_of_odd_documents(spark, odd, none):
    rows = packing.cut_documents(odd, capacity=100).collect()
    assert sum(r["piece"] == 0 for r in rows) == 10 and max(r["length"] for r in rows) == 100
    assert packing.cut_documents(none).count() == 0


def test_near_duplicates(odd, none, spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(odd).collect()), key=str)
    assert (None, 1, None, True) in got and got.count((5, 1, 4, False)) == 2 and (4, 1, 4, True) in got
    assert {r for r in got if r[0] in (1, 2, 3)} == {(k, 0, k, True) for k in (1, 2, 3)}
    assert near_dups.near_duplicates(none).count() == 0
    chain = [" ".join(f"w{i}" for i in range(a, a + 60)) for a in range(0, 40, 4)]  # neighbours are alike, ends are not
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(chain)], "doc_id long, text string")
    assert {r["component_id"] for r in near_dups.near_duplicates(df).collect()} == {1}


def test_large_family_of_near_copies(spark):
    draw = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in draw.choice(80, int(draw.integers(0, 4)), replace=False):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(near_dups.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(df, block=16).collect()}
    assert got == {i: top(i) for i in range(len(texts))}


def test_decontamination(spark, odd, none):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, passage), (2, None), (3, "!!"), (4, "same text"), (1, passage)], "item_id long, text string")
    changed = passage.replace("four", "vier")
    docs = spark.createDataFrame([(1, f"before {changed} after"), (2, f"{passage}."), (3, None), (None, passage.upper()), (4, "one two three")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_leaks(docs, items).collect()), key=str)
    assert got == [(1, 1, 1), (2, 1, 0), (None, 1, 0)]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, items).collect()} == {(4, 4), (5, 4), (None, 4)}
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(docs, items.where("false")).count() == 0


def test_decontamination_finds_edited_passages(spark):
    """At the allowed distance, with edits over the whole item, its first half and its start."""
    items, docs, n = [], [], 0
    for length in (20, 50, 100, 200, 300):
        edits, draw = length // 10, np.random.default_rng(length)
        for within in (length - edits, length // 2, 2 * edits):
            for _ in range(24):
                item = [f"i{n}w{i}" for i in range(length)]
                words = list(item)
                for e in range(edits):
                    at = int(draw.integers(within))
                    if e % 3:
                        words[at:at + e % 2] = [f"x{e}"] * (1 - e % 2)  # deleted or inserted
                    else:
                        words[at] = f"x{e}"
                items.append((n, " ".join(item)))
                docs.append((n, " ".join(["before"] * 400 + words + ["after"] * 400)))
                n += 1
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r["doc_id"] for r in found}
    assert all(r["doc_id"] == r["item_id"] for r in found) and len(got) >= 0.99 * n
    assert min(sum(d in got for d in range(a, a + 72)) for a in range(0, n, 72)) >= 70


def test_decontamination_walks():
    """Each walk reads whole items, and long items get as many as they need."""
    rows = np.arange(1, 41, dtype=np.uint64).reshape(1, -1)
    ends = [decontaminate.cgk_walk(rows, np.array([40]), walk, np.array([[0, 119]]))[:, 0].tolist() for walk in range(5)]
    assert ends == [[1, 0]] * 5
    for length in (20, 59, 200, 400):
        edits = decontaminate.edits_allowed(length, 0.1)
        for within in (length - edits, length // 2, 2 * edits):
            rows, changed = decontaminate.edited_pairs(length, edits, within, np.random.default_rng([9, within]), 300)
            lengths, missed = np.full(300, length), np.ones(300, bool)
            for walk in range(decontaminate.walks_for(length, 0.1)):
                missed &= decontaminate.keys_of(rows, lengths, walk) != decontaminate.keys_of(changed, lengths, walk)
            assert missed.mean() <= 0.01, (length, within)


def test_language(spark, odd, none):
    rows = [("the cat and the dog in the house", "en"), ("der Hund und die Katze in dem Haus", "de")] * 5
    model = language_mix.train(spark.createDataFrame(rows, "text string, lang string"))
    got = language_mix.identify(odd, model)
    assert set(got.columns) == {*odd.columns, "lang_pred", "languages"} and got.count() == 10
    und = {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3, 7}
    mixed = spark.createDataFrame([("the dog and the cat in the house " * 20 + "die Katze und der Hund in dem Haus " * 20,)], "text string")
    assert {x["lang"] for x in language_mix.identify(mixed, model).first()["languages"]} == {"de", "en"}
    assert language_mix.identify(none, model).count() == 0
    nothing = language_mix.train(spark.createDataFrame([], "text string, lang string"))
    assert language_mix.identify(odd, nothing).where("lang_pred <> 'und'").count() == 0


def test_toxicity_grammar(spark, odd, none):
    g = toxicity.Grammar({"idiot": 2.0, "scum*": 2.0})
    weight = lambda t: sum(w for _, _, w in g.clauses(t))
    assert weight("You idiot.") > weight("An idiot.") > weight("Not an idiot.") > 0
    assert weight("He said idiot.") < weight("He, idiot.") and weight("Scumbags!") == 2.0 and weight("idiotic words") == 0
    assert g.clauses("Fine. You idiot! Fine.") == [(5, 15, 2.5)]
    got = toxicity.score_toxicity(odd, g)
    assert got.where("score between 0 and 1").count() == 10 and toxicity.score_toxicity(none, g).count() == 0
    empty = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert empty.insults == {}


def test_toxicity_search_passes_over_no_match(spark):
    g = toxicity.Grammar({"débilé": 2.0, "idiot": 2.0, "σκύλος": 2.0, "scum*": 2.0} | {f"q{i:b}".translate({48: "é", 49: "z"}): 1.0 for i in range(toxicity.PATTERNS)})
    words = ["débilé", "DÉBILÉ", "idiot", "kill", "tué", "ΣΚΎΛΟΣ", "ΣΚΎΛΟΣ", "scumé", "brûler"]
    ends = ["", " x", ".", ".Α", "99", "_x", "'", "'s", "é", "́", "²", "\n", "\u00a0x"]
    starts = ["", "un ", "9", "_", "'", "İ", "é", "x'", "é. "]
    texts = [a + w + b for a in starts for w in words for b in ends]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(c) for c in r["clauses"]] for r in toxicity.score_toxicity(df, g).collect()}
    assert got == {i: g.clauses(t) for i, t in enumerate(texts)} and sum(map(bool, got.values())) > 200


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(30)]
    rows += [(100, None), (101, [0.0] * 8), (102, [1.0] * 7), (103, [float("nan")] * 8), (104, [None] * 8), (105, rows[0][1]), (None, rows[1][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own"))
    got = ann.nearest(df, df.where("vec_id in (0, 1, 100)"), k=50)
    assert got.groupBy("query_id").count().where("count = 30").count() == 2
    top = got.where("query_id = 0").orderBy("rank").first()
    assert top["vec_id"] == 105
    assert ann.nearest(df.where("false"), df).count() == 0 and ann.nearest(df, df.where("false")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a\\<|im_end|>\n\\n b"), (1, 1, "assistant", None), (1, 1, "assistant", "x<|"), (1, 1, "assistant", "x<|"), (None, 0, None, "t"), (2, None, "as\nsi|<|\\n", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("own"))
    out = chat_format.format_conversations(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    read = {r["conv_id"]: r for r in out.select("conv_id", "n_turns", "loss_spans", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [tuple(t) for t in read[1]["t"]] == [("user", "a\\<|im_end|>\n\\n b"), ("assistant", ""), ("assistant", "x<|"), ("assistant", "x<|")]
    assert read[1]["l"] == ["", "x<|", "x<|"] and tuple(read[2]["t"][0]) == ("as\nsi|<|\\n", "") and tuple(read[None]["t"][0]) == ("", "t")
    for r in read.values():
        for s in r["loss_spans"]:
            assert r["formatted"][s["start"] - len("assistant\n"):s["start"]] == "assistant\n"
    assert out.where("false").count() == 0


def test_chat_parts(spark):
    parts = [[("text", "see ", None, None), ("image", None, "i.png", 2.0), ("text", " and ", None, None), ("audio", None, "a.wav", 0.5), None, ("strange", "z", None, None)], None]
    df = spark.createDataFrame([(1, i, "user", p) for i, p in enumerate(parts)], f"conv_id long, turn int, role string, parts {chat_format.PARTS}")
    r = chat_format.format_conversations(df).first()
    assert r["formatted"] == "<|im_start|>user\nsee <|image|> and <|audio|>z<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a["ref"], a["tokens"], r["formatted"][a["position"]:a["position"] + 7]) for a in r["attachments"]] == [("i.png", 512, "<|image"), ("a.wav", 13, "<|audio")]
    assert r["expanded_tokens"] == 525


def test_url_rules(spark):
    urls = ["http://a.NET/x", "http://example.net/en/1", "http://example.net/en", "http://www.example.com/de/?q", "x://b.org/fr/#t", None, "no url", "http://net", "http://evilnet/",
            "http://net.example/", "http://a.net:80/", "http://a.net/x", "http://" + "a." * 500 + "net" + "/" * 500]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("own"))
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block"), ("net", "/x", "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, rules).collect()}
    assert got[0] == ("a.net", "/x", "net/x", "allow") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == ("www.example.com", "/de/", "example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("net", "", None, "allow")
    assert got[8][2] is None and got[9][2] is None and got[10][:3] == ("a.net:80", "/", None) and got[12][2:] == ("net/", "block") and len(got) == len(urls)
    assert url_rules.judge_urls(df.where("false"), rules).count() == 0
    assert url_rules.judge_urls(df, rules.where("false")).where("verdict <> 'allow'").count() == 0


def test_pages(spark):
    body = "<nav>menu</nav><header>top</header><div class='cookie-notice'>we use</div><{a}><h1>T{i}</h1><p>one &amp; two<p>x  y\n<b>z</b>{i}<ul><li>l</ul><form>f</form><script>if (a<b) p()</script></{a}><aside>side</aside><section class='comments'><p>c</p></section><footer>f</footer>"
    pages = [(i, "http://h.x/", body.format(a="article", i=i)) for i in range(5)] + [(10 + i, "http://g.x/", body.format(a="div", i=i)) for i in range(5)]
    pages += [(20, None, None), (21, "http://h.x/", ""), (22, "http://z.x/", "<p>plain"), (23, "u", "<article><p>t</article>"), (23, "u", "<article><p>t</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = {r["page_id"]: r["text"] for r in page_template.extract_text(df).collect()}
    assert got[1] == got[11] == "T1\none & two\nx y z1\nl"
    assert got[20] == got[21] == "" and got[22] == "plain" and got[23] == "t"
    assert page_template.extract_text(df.where("false")).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    body = "<body><div class='top'><p>Site of the day</p></div><div class='post'><h1>{0}</h1><p>{0} text</p><p>same</p></div></body>"
    rows = [(i, "http://a.x/", body.format("copied")) for i in range(4)] + [(10 + i, "http://a.x/", body.format(w)) for i, w in enumerate(["one", "two", "three"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_template.extract_text(df).collect()}
    assert got == {**{i: "copied\ncopied text\nsame" for i in range(4)}, **{10 + i: f"{w}\n{w} text\nsame" for i, w in enumerate(["one", "two", "three"])}}


def test_names_inside_an_article(spark):
    body = "<article><p>A</p><div class='related work'><p>kept para {0}</p></div><section class='share'><p>shares fell</p></section><div class='ad'>buy</div><p>end</p></article>"
    alone = [(1, "http://b.x/", body.format(1))]
    more = [(10 + i, "http://c.x/", f"<body><article><h1>T{i}</h1><p>t{i}</p><div class='share'>Share this</div></article><p>foot</p></body>") for i in range(4)]
    df = spark.createDataFrame(alone + more, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_template.extract_text(df).collect()}
    assert got[1] == "A\nkept para 1\nshares fell\nend"
    assert got[11] == "T1\nt1"  # an element of the template whose name says that it is no text


def test_classes_nest(spark):
    page = "<body><nav><ul>{0}</ul></nav><div class='a'><div class='b'><p>x{1}</p></div></div></body>"
    rows = [("h", page.format("<li>l</li>" * 3, i), i) for i in range(4)] + [("h", page.format("<li>l</li>" * 3, 0), 0)]
    df = spark.createDataFrame(rows, "host string, html string, page long")
    occurring = page_template.occurrences(df)
    assert occurring.where("kind = 'page'").first()["pages"] == 4
    found = {r["token"]: r for r in page_template.templates(occurring).collect() if r["kind"] == "tag"}
    root, item = found["/body/div.a/div.b"], found["/body/nav/ul/li"]
    assert root["parent"] is None and item["parent"] == root["vector"] == found["/body"]["vector"] and item["most"] == 3
    assert [r["holder"] for r in page_template.holders(occurring, page_template.templates(occurring)).collect()] == ["/body/div.a/div.b"]


def test_raw_elements_without_an_end():
    text = lambda page: [t for _, t in page_template.article(page, frozenset(), frozenset())]
    assert text("<header><svg class='a' /></header><article><p>one<svg><path/></svg><p>two</article>") == ["one", "two"]
    for name in ("object", "select", "noscript", "iframe", "template", "svg"):
        assert text(f"<{name}><article><p>one</article>") == ["one"] and text(f"<{name}>x</{name}><p>one") == ["one"], name
    assert text("<p>one<script>if (a<b) p()") == ["one"]


def test_pipeline_stages_take_odd_rows(spark, odd, sf):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, odd.where("false")):
            out = stage(spark, docs, sf)
            assert out.columns == odd.columns, name
            assert out.count() <= docs.count() and out.where("score <> 'own'").count() == 0
    assert corpus_pipeline.packed(spark, odd, sf).where("piece = 0").count() == 10


def test_pipeline_texts_reach_python_once_in_small_batches(spark, odd, sf):
    import corpus_pipeline
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    key, rows, length = "spark.sql.execution.arrow.maxBytesPerBatch", 1000, 20_000
    wide = spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('a', {length})").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    spark.conf.unset(key)
    try:
        for _, stage in corpus_pipeline.STAGES:  # each on its own, as stages may be called
            spark.conf.unset(key)
            stage(spark, odd, sf)
            found = [r["n"] for r in corpus_pipeline._rows(wide).mapInArrow(sizes, "n long").collect()]
            assert max(found) < 6_000_000 and rows * length <= sum(found) < 1.2 * rows * length
        spark.conf.set(key, "16m")  # a size that the session has set holds
        corpus_pipeline.language(spark, odd, sf)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.unset(key)


def test_pipeline_keeps_columns_of_any_names_and_order(spark, sf):
    import corpus_pipeline

    row = {"score": "own", "text": "the same words are here to read", "lang_pred": 1, "doc_id": 7, "lang": "en", "__text": None, "clauses": "c"}
    docs = spark.createDataFrame([tuple(row.values())], "score string, text string, lang_pred int, doc_id long, lang string, __text string, clauses string")
    for stage in (corpus_pipeline.language, corpus_pipeline.clean_language):
        assert [r.asDict() for r in stage(spark, docs, sf).collect()] == [row] and stage(spark, docs, sf).columns == docs.columns
    bare = docs.select("doc_id", "text")
    assert corpus_pipeline.clean_language(spark, bare, sf).collect() == [(7, row["text"])]
