"""TIFF pages, byte-level BPE and WARC: round trips, brute force, and awkward inputs."""

import base64
import gzip
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from framesift.llm import bpe, queries, tiff, warc
from framesift.llm.common import table
from tests.oracle import assert_same, connect

AWKWARD = [(1, None, 0), (2, "", 0), (3, "x", 1), (4, " \n\t ", 2), (5, "é" * 96, 3), (6, "a" * 192, 4), (7, "word " * 60_000, 5), (7, "word " * 60_000, 5), (8, "\0\x1c\U0001f600ſ", 6), (None, "no id", 7)]
SCHEMA = "doc_id bigint, text string, content int"  # content clashes with a name that the operators use


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [tiff.PLAIN, tiff.DIFFERENCE])
@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trip(scheme, predictor, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, top, shape, dtype=np.uint8) for top, shape in ((3, (1, 1)), (256, (37, 53, 3)), (2, (200, 192)), (256, (90, 192)))]
    found = list(tiff.read(tiff.encode(pages, scheme, predictor, rows=16, tile=tile, order=order)))
    assert [p.pixels for p in found] == [p.tobytes() for p in pages]
    assert all((p.compression, p.predictor) == (scheme, predictor) for p in found)


def test_packbits_and_lzw_known_bytes():
    """The worked examples of the formats' descriptions."""
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), len(plain)) == plain
    assert tiff.packbits_decode(tiff.packbits_encode(plain), len(plain)) == plain
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = int(codes.ljust(-(-len(codes) // 8) * 8, "0"), 2).to_bytes(-(-len(codes) // 8), "big")
    assert tiff.lzw_encode(bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))) == packed and tiff.lzw_decode(packed, 9) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))


def test_tiff_planar_and_broken():
    image = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    planes = [image[:, :, k].tobytes() for k in range(3)]
    body = b"".join(planes)
    fields = [(256, 4, 1, 2), (257, 4, 1, 2), (258, 3, 1, 8), (259, 3, 1, 1), (277, 3, 1, 3), (278, 4, 1, 2), (284, 3, 1, 2)]
    head = struct.pack("<2sHI", b"II", 42, 8 + len(body) + 24)
    arrays = struct.pack("<3I", *(8 + 4 * k for k in range(3))) + struct.pack("<3I", 4, 4, 4)
    at = 8 + len(body)
    entries = sorted([struct.pack("<HHII", *f) for f in fields] + [struct.pack("<HHII", 273, 4, 3, at), struct.pack("<HHII", 279, 4, 3, at + 12)], key=lambda e: e[:2][::-1])
    data = head + body + arrays + struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0)
    (page,) = tiff.read(data)
    assert page.pixels == image.tobytes()
    for bad in (None, b"", b"II*\0", data[:20], data[: len(data) - 30], b"not a tiff at all"):
        assert all(isinstance(p, tiff.BadTiff) for p in tiff.read(bad))


def test_tiff_pages_of_awkward_rows(spark, awkward):
    stored = tiff.store_text(awkward)
    found = tiff.pages(stored, keep=("doc_id", "n_bytes")).collect()
    assert len(found) == len(AWKWARD)
    wanted = {(i, (t or "").encode()) for i, t, _ in AWKWARD}
    assert {(r.doc_id, bytes(r.pixels)[: r.n_bytes]) for r in found} == wanted
    assert all(len(r.pixels) % 192 == 0 and len(r.pixels) and not bytes(r.pixels)[r.n_bytes :].strip(b" ") for r in found)
    assert tiff.pages(stored.limit(0), keep=("doc_id",)).count() == 0
    broken = spark.createDataFrame([(1, None), (2, b"nonsense")], "doc_id int, content binary")
    assert [r.error is not None for r in tiff.pages(broken).collect()] == [True, True]
    pages = [np.zeros((4, 5), np.uint8), np.ones((3, 2), np.uint8)]
    many = spark.createDataFrame([(1, tiff.encode(pages))], "doc_id int, content binary")
    assert [(r.page, r.width, r.height) for r in tiff.pages(many).orderBy("page").collect()] == [(0, 5, 4), (1, 2, 3)]


def test_op1(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    found = queries.op1_tiff_media(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_op1_stored_form_and_feature(spark, awkward):
    """Length and hash of the stored bytes, and the feature from the payload's samples one by one."""
    stored = {(r.doc_id, r.n_bytes): bytes(r.content) for r in tiff.store_text(awkward).collect()}
    for r in tiff.pages(tiff.store_text(awkward), keep=("doc_id", "n_bytes")).collect():
        content, raw = stored[r.doc_id, r.n_bytes], bytes(r.pixels)
        assert (r.media_bytes, r.media_sha256) == (len(content), hashlib.sha256(content).hexdigest())
        n, mean = len(raw), sum(raw) / len(raw)
        spread = max(0.0, sum(x * x for x in raw) / n - mean**2) ** 0.5
        steps = sum(abs(a - b) for a, b in zip(raw, raw[192:])) / n
        assert r.feature == f"192x{n // 192}x1 mean={mean:.4f} sd={spread:.4f} step={steps:.4f}"
    # compression is dealt by the payload's checksum, whatever its size
    kinds = {r.compression for r in tiff.pages(tiff.store_text(spark.createDataFrame([(i, f"{i} " * 40_000) for i in range(40)], "doc_id int, text string"))).collect()}
    assert kinds == {tiff.LZW, tiff.DEFLATE, tiff.PACKBITS}


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op5(spark, sf_dir, awkward, reference, monkeypatch):
    own = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()] + [(i, t) for i, t, _ in AWKWARD]
    wanted = []
    for i, t in own:
        ids = reference.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    found = queries.op5_byte_bpe(spark, sf_dir).collect() + bpe.round_trip(awkward, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_bpe_runs_and_cache_dont_change_ids(reference, monkeypatch):
    monkeypatch.setattr(bpe, "RUN_CHARS", 7)
    monkeypatch.setattr(bpe, "CACHE", 5)
    coder = bpe.ByteBpe(P.path("byte_bpe_50k.json"), P.PATTERN)
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice("ab  \n\t'sé1!\x1c 字") for _ in range(rnd.randint(0, 60)))
        assert [i for run in coder.encode(text) for i in run] == reference.encode_ordinary(text)


def test_bpe_offsets_and_split_characters(spark):
    df = spark.createDataFrame([(1, "héy 字\U0001f600!"), (2, None)], "doc_id int, text string")
    rows = {r.doc_id: r for r in bpe.encode_ids(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    text, r = "héy 字\U0001f600!", rows[1]
    assert rows[2].ids == [] and r.starts[0] == 0 and r.ends[-1] == len(text)
    assert any(a == c for a, c in zip(r.starts, r.starts[1:]))  # tokens that share one character
    assert all(a < b for a, b in zip(r.starts, r.ends))
    back = bpe.decode_ids(bpe.encode_ids(df, P.path("byte_bpe_50k.json"), P.PATTERN), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert {x.doc_id: bytes(x.content) for x in back} == {1: text.encode(), 2: b""}


def test_op10_equals_sql(spark, sf_dir):
    assert_same(queries.op10_warc(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op10_warc"])


def test_chunks():
    for n in (0, 1, 8191, 8192, 20_000):
        assert warc.unchunked(warc.chunked(bytes(n))) == bytes(n)
    assert warc.unchunked(b"5;x=y\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"
    for bad in (b"", b"5\r\nhel", b"zz\r\n\r\n", b"5\r\nhelloXX0\r\n\r\n", b"-1\r\n\r\n"):
        assert warc.unchunked(bad) is None


def test_warc_awkward_pages(spark, tmp_path):
    long, same = "WARC/1.1\r\n\r\n" * 20_000, "s" * 1500
    rows = [(1, "u", None, 0), (2, None, "", 0), (3, "u\r\nX: y", long, 0), (4, "u", same, 0), (9, "u", same, 0), (5, "u", same, 0), (6, "u", "short", 0), (7, "u", "short", 0), (None, "u", same, 0), (8, "u", long[:-1], 0), (8, "u", long[:-1], 0)]
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string, block int"), path)
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(rows) and all(r.valid for r in found)
    kinds = {}
    for r in found:
        kinds.setdefault(r.record_id.split(":")[2], []).append((r.record_type, r.stated_bytes))
    assert kinds["4"] == kinds["5"] == [("revisit", 1500)] and kinds["9"] == [("response", 1500)] and kinds[""] == [("response", 1500)]
    assert kinds["6"] == kinds["7"] == [("response", 5)] and kinds["1"] == kinds["2"] == [("response", 0)]
    assert kinds["8"] == [("response", len(long) - 1)] * 2
    assert {bytes(r.payload) for r in found if r.record_id.startswith("<urn:page:3:")} == {long.encode()}
    refers = {r.refers_to for r in found if r.record_type == "revisit"}
    assert refers == {r.record_id for r in found if r.record_id.startswith("<urn:page:9:")}
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path + "-none")
    assert warc.read_archives(spark, path + "-none").count() == 0


def test_damaged_archives_dont_stop_the_job(spark, tmp_path):
    good = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], b"HTTP/1.1 200 OK\r\n\r\nbody") + b"\r\n\r\n"
    packed = gzip.compress(good)
    damaged = packed + packed[:20] + bytes(30)
    files = {
        "good.warc": good, "bytes.warc": b"no record at all\r\n\r\nx", "empty.warc": b"", "nolength.warc": good + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx",
        "length.warc": b"WARC/1.1\r\nContent-Length: \xc2\xb2\r\n\r\n", "cut.warc": good[:-10], "member.warc.gz": damaged, "cutgzip.warc.gz": packed[:-12],
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sum(r.valid for r in found) >= 3 and all(bytes(r.payload) == b"body" and r.record_id == "<a>" for r in found if r.valid)
    faults = warc.read_records(spark, f"file://{tmp_path}").where("error IS NOT NULL").collect()
    assert len(faults) == 6 and all(r.record_id is None and r.block is None for r in faults)
    assert sum(not r.valid for r in found) == 6


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_archives_read_in_steps(step):
    blocks = [b"", b"x" * 5000, b"WARC/1.1\r\n\r\n" * 9, bytes(300)]
    parts = [warc.record([("WARC-Record-ID", i)], b) + b"\r\n\r\n" for i, b in enumerate(blocks)]
    for whole in (b"".join(parts), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts)), gzip.compress(parts[0]) + b"".join(parts[1:])):
        assert [b for _, b in warc.records(warc.inflated(memoryview(whole), step))] == blocks
    cut = list(warc.records(warc.inflated(memoryview(gzip.compress(b"".join(parts))[:-9]), step)))
    assert isinstance(cut[-1], str) and [b for _, b in cut[:-1]] == blocks[: len(cut) - 1]
    # a file that isn't an archive is given up at its first bytes, however long it is
    assert list(warc.records(iter([b"no archive", None]))) == ["no record at byte 0"]
    for bad in (b"9" * 5000, b"99999999999", b"\xc2\xb2", b""):
        assert isinstance(next(warc.records([b"WARC/1.1\r\nContent-Length: " + bad + b"\r\n\r\n"])), str)


def test_archives_are_cut_by_bytes_and_digests_travel_either_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CELLS", 2)
    rows = [(i, "u", f"{i % 7} " * (600 + 1000 * (i % 7))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    found = []
    for limit in (0, 6, 7):
        path = f"{tmp_path}/warc{limit}"
        warc.write_archives(df, f"file://{path}", broadcast_digests=limit, cell_bytes=4000)
        sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / f"warc{limit}").glob("*.gz")]
        assert len(sizes) > 5 and max(sizes) < 2 * (4000 + 15_000)
        found.append({(r.record_id, r.record_type, r.refers_to, r.stated_bytes, r.valid) for r in warc.read_archives(spark, f"file://{path}").collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 60 and sum(r[1] == "response" for r in found[0]) == 7
    faults = warc.read_records(spark, f"file://{tmp_path}/warc0", max_file_bytes=10).collect()
    assert len(faults) > 5 and all(r.error.endswith("bytes") and r.block is None for r in faults)


def test_reassembly_finds_faults(spark):
    columns = ["record_id", "record_type", "segment", "origin_id", "total_length", "refers_to", "target_uri", "payload_digest", "block"]
    part = lambda origin, n, block, total=None: (origin if n == 1 else f"{origin}.{n}", "response" if n == 1 else "continuation", n, None if n == 1 else origin, total, None, None, None, block)
    rows = [part("a", 2, b"cd", 4), part("a", 1, b"ab"), part("b", 1, b"ab"), part("b", 3, b"e", 5), part("c", 2, b"x", 3), part("d", 1, b"ab"), part("d", 2, b"c", 9), part("e", 1, b"ab"), part("e", 2, b"c", 3), part("e", 2, b"d", 3)]
    found = spark.createDataFrame(rows, "record_id string, record_type string, segment int, origin_id string, total_length bigint, refers_to string, target_uri string, payload_digest string, block binary").select(columns)
    assert {(r.record_id, r.complete) for r in warc.reassemble(found).collect()} == {("a", True), ("b", False), ("c", False), ("d", False), ("e", False)}
    assert {bytes(r.block) for r in warc.reassemble(found).where("complete").collect()} == {b"abcd"}


def test_media_names_may_clash(spark):
    df = spark.createDataFrame([(1, "t", 5, "k")], "doc_id int, text string, pixels int, error string")
    assert tiff.pages(tiff.store_text(df)).select(F.col("pixels")).count() == 1
