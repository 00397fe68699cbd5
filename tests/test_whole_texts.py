"""Queries without an SQL twin read whole texts, held against brute force on a small fixture."""

import pytest

import __spark_entry__
from tessera.operators import codec, filters, raster
from tessera.plans import container_queries, filter_queries

TEXTS = ["", "short", "x" * 16, "words of a text é " * 40, "".join(chr(97 + k * k % 26) for k in range(1500))]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(9, None)], "doc_id bigint, text string").write.parquet(f"{where}/documents.parquet")
    return where


def tiles_by_hand():
    out = {}
    for k, t in enumerate(TEXTS):
        d = t.encode()
        d += bytes(-len(d) % 16)
        out |= {(k, i // 256): d[i : i + 256] for i in range(0, len(d), 256)}
    return out


def test_tiles_hold_the_whole_text(spark, small):
    got = {(r.img_id, r.tile_id): bytes(r.data) for r in raster.whole_tiles(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got == tiles_by_hand() and max(got)[1] == 5


def test_best_filter_of_every_tile(spark, small):
    got = {(r.img_id, r.tile_id): (r.code, r.score) for r in filter_queries.best_filters_of_texts(spark, small).collect()}
    tiles = tiles_by_hand()
    alone = spark.createDataFrame([(n, bytearray(d)) for n, d in enumerate(tiles.values())], "img_id bigint, data binary")
    want = {r.img_id: (r.code, r.score) for r in filters.best_filter(filters.scores(alone)).collect()}
    assert got == {key: want[n] for n, key in enumerate(tiles)}


def test_compressed_sizes_cover_all_tiles(spark, small):
    got = {(r.img_id, r.code): r.size for r in filter_queries.compression_test(spark, small).collect()}
    assert len(got) == 16 * 4
    for k in range(1, len(TEXTS)):
        raw = [d for (n, _), d in tiles_by_hand().items() if n == k]  # filter 0 leaves the bytes as they are
        assert got[k, 0] == sum(len(codec.compress(d, codec.LEVEL)[1]) for d in raw)


def test_a_dictionary_for_each_text(spark, small):
    got = {r.img_id: r.n for r in container_queries.train_dictionary(spark, small).collect()}
    for k in range(1, len(TEXTS)):
        want = codec.train([d for (n, _), d in sorted(tiles_by_hand().items()) if n == k][: codec.DICT_TILES])
        assert got[k] == (len(want) if want else None)


def test_entry_reads_whole_texts(spark, sf):
    n = [len(r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    assert __spark_entry__.entry(spark).count() == sum(-(-x // 256) for x in n) > len(n)


def test_all_documents_are_streamed(spark, tmp_path):
    texts = {k: "words of a text " * (k % 40 * 9 + 1) for k in range(150, 260)}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.img_id: (r.chunks, r.tiles, r.budget, r.ended) for r in container_queries.QUERIES["stream_chunk_progress"](spark, str(tmp_path)).collect()}
    want = {}
    for k, t in texts.items():
        height = -(-len(t) // 1024)
        want[k] = (2 + -(-height // 2), -(-height // 2), 1025 * height, True)
    assert got == want
