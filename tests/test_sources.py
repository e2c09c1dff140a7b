from pyspark.sql import functions as F

from colloquy import runtime
from colloquy.plans.ingestion import build_chunks, prepare_documents, update_collection
from colloquy.sources.files import scan_documents, scan_line_list
from colloquy.sources.store import CHUNKS, dump_chunks, insert_new, open_chunks, write_chunks
from colloquy.streaming.ingest import ingest_stream

TEXT = "Robots move. They have arms. Music is loud. It has rhythm. "


def test_scan(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "deep" / "b.md").write_text("three")
    (tmp_path / "c.pdf").write_text("no")
    got = {r.file_name: (r.text, r.file_size) for r in scan_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("one\ntwo", 7), "b.md": ("three", 5)}


def test_line_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n\nmodel:1b\n  #model:2b\n other \n")
    assert [r.value for r in scan_line_list(spark, str(tmp_path / "list.txt")).collect()] == ["model:1b", "other"]


def chunk_rows(spark, ids):
    return spark.createDataFrame([(i, 1, 0, f"t{i}", 1, "h", [1.0], {"a": "b"}) for i in ids], CHUNKS)


def test_collection(spark, tmp_path):
    path = str(tmp_path / "chunks")
    assert open_chunks(spark, path).count() == 0 and not (tmp_path / "chunks").exists()
    write_chunks(chunk_rows(spark, "ab"), path)
    write_chunks(chunk_rows(spark, "c"), path)
    assert sorted(r.text for r in dump_chunks(open_chunks(spark, path)).collect()) == ["ta", "tb", "tc"]
    write_chunks(chunk_rows(spark, "d"), path, wipe=True)
    assert [r.metadata for r in open_chunks(spark, path).collect()] == [{"a": "b"}]


def test_insert(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "b"), (3, "a")], "id int, v string")
    assert sorted(map(tuple, insert_new(old, new, "id").collect())) == [(1, "old"), (2, "old"), (3, "a")]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, '{"page": 1, "list": [1]}') for i, t in enumerate(texts)], "doc_id bigint, text string, metadata string")


def test_update_skips_what_is_known(spark, tmp_path):
    path = str(tmp_path / "store")
    size = {"chunk_size": 6, "overlap": 0}
    read, made = update_collection(spark, docs(spark, TEXT, "Short one."), path, **size)
    assert read == 2 and made > 2
    stored = open_chunks(spark, path)
    assert {tuple(r.metadata.items()) for r in stored.collect()} == {(("page", "1"),)}
    assert {len(r.embedding) for r in stored.collect()} == {256}
    assert update_collection(spark, docs(spark, TEXT, "Short one."), path, **size) == (2, 0)
    assert update_collection(spark, docs(spark, TEXT, "Another text."), path, **size) == (2, 1)
    assert update_collection(spark, docs(spark, TEXT), path, wipe=True, **size)[1] == made - 1


def test_incremental_stream(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        ingest_stream(spark, str(folder), out, state, chunk_size=6, overlap=0).awaitTermination()
        return open_chunks(spark, out)

    (folder / "a.txt").write_text(TEXT)
    first = run().count()
    assert first > 1
    assert run().count() == first
    (folder / "b.md").write_text("New words here.")
    (folder / "copy.txt").write_text(TEXT)
    names = [r.metadata["file_name"] for r in run().collect()]
    # a chunk is known if its own document has it, so an equal file is stored as well
    assert len(names) == 2 * first + 1 and names.count("b.md") == 1 and names.count("copy.txt") == first


def test_documents_without_or_with_a_repeated_id(spark, tmp_path):
    """No chunk is lost to a null id, none is doubled by a repeated row, and texts of one id do not mix."""
    shape = "doc_id bigint, text string, metadata string"
    rows = [(None, TEXT, '{"page": 1}'), (None, TEXT, '{"page": 1}'), (None, "Other words.", None), (5, TEXT, '{"page": 2}'), (5, TEXT, '{"page": 2}'),
            (6, "One text. It is short.", None), (6, "Another text of the same id.", None), (7, None, None), (8, "...", None)]
    docs, size = spark.createDataFrame(rows, shape), {"chunk_size": 6, "overlap": 0}
    alone = {t: [r.text for r in build_chunks(prepare_documents(spark.createDataFrame([(1, t, None)], shape)), **size).orderBy("chunk_id").collect()]
             for t in {t for _, t, _ in rows if t and t != "..."}}
    path = str(tmp_path / "store")
    read, made = update_collection(spark, docs, path, **size)
    got = open_chunks(spark, path).collect()
    want = [(i, c) for i, t in {(i, t) for i, t, _ in rows if t and t != "..."} for c in alone[t]]
    assert read == 9 and made == len(want) and sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert len({r.chunk_id for r in got}) == len(got)
    assert {r.metadata["page"] for r in got if r.doc_id == 5} == {"2"}
    assert update_collection(spark, docs, path, **size) == (9, 0)


def test_size_check(spark):
    assert runtime.within(spark.range(5), 5) and not runtime.within(spark.range(6), 5)


def test_written_tables_keep_rows(spark):
    df = spark.range(50).select(F.col("id"), F.array(F.col("id").cast("float")).alias("v"))
    assert sorted(map(tuple, runtime.materialize(df).collect())) == sorted(map(tuple, df.collect()))
