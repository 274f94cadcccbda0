import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from fieldmill.llm import op04_media as media


def test_round_trip():
    random.seed(2)
    payloads = [os.urandom(192 * random.randint(1, 9)) for _ in range(20)] + [b" " * 192, b"\xff" * 1920, bytes([0, 255]) * 960, os.urandom(192 * 8100)]
    stored = media.encode_payloads(payloads)
    assert [b"".join(t.tobytes() for t in x) for x in media.dc_thumbnails(stored)] == payloads
    assert [media.encode_payloads([p])[0] for p in payloads[:5]] == stored[:5]
    assert len(media.parse_images(stored[-1])) == 2


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def write_colour_image(blocks_of, restart):
    """A 4:2:0 image of 3 x 2 MCUs with AC coefficients; the blocks' DC values come from blocks_of(mcu)."""
    counts, values = [0] * 16, list(range(256))
    counts[7], counts[8] = 255, 1  # flat codes of eight bits, one of nine
    codes = media.huffman_codes(counts, values)
    table = bytes([*counts, *values])
    out = b"\xff\xd8" + media._segment(0xDB, bytes([0] + [4] * 64)) + media._segment(0xC0, bytes([8, 0, 32, 0, 48, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out += media._segment(0xC4, bytes([0x00]) + table) + media._segment(0xC4, bytes([0x10]) + table)
    if restart:
        out += media._segment(0xDD, restart.to_bytes(2, "big"))
    out += media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    rng = random.Random(4)
    bits, last = Bits(), {}
    for mcu in range(6):
        if restart and mcu and mcu % restart == 0:
            out += bits.data() + bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
            bits, last = Bits(), {}
        for c, dc in blocks_of(mcu):
            diff = dc - last.get(c, 0)
            last[c] = dc
            size = abs(diff).bit_length()
            bits.put(*codes[size])
            bits.put(diff if diff >= 0 else diff + (1 << size) - 1, size)
            k = 1
            while k < 64:
                run, size = rng.choice([(0, 0), (15, 0), (2, 3), (5, 1)])
                if (run, size) == (15, 0) and k + 16 > 63 or size and k + run > 63:
                    run, size = 0, 0
                bits.put(*codes[run << 4 | size])
                if size:
                    bits.put(rng.randrange(1 << size), size)
                k = 64 if (run, size) == (0, 0) else k + run + 1
    return out + bits.data() + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 4])
def test_reads_subsampled_colour_images(restart):
    rng = random.Random(9)
    plan = [[(1, rng.randint(-200, 200)) for _ in range(4)] + [(2, rng.randint(-200, 200)), (3, rng.randint(-200, 200))] for _ in range(6)]
    (thumb,) = media.dc_thumbnails([write_colour_image(lambda m: plan[m], restart)])[0]
    wanted = np.zeros((4, 6), dtype=int)
    for m, blocks in enumerate(plan):
        for i in range(4):
            wanted[m // 3 * 2 + i // 2, m % 3 * 2 + i % 2] = min(255, max(0, 128 + (blocks[i][1] * 4 + 4) // 8))
    assert (thumb == wanted).all()


def test_bad_bytes():
    for bad in (b"no image", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00\xff\xd9", media.encode_payloads([b"a" * 192])[0][:-40]):
        with pytest.raises(ValueError):
            media.dc_thumbnails([bad])


def check(rows, texts):
    for r in rows:
        plain = (texts[r["doc_id"]] or "").encode()
        payload = plain.ljust(max(1, -(-len(plain) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(plain), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])


def test_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(media.op4_media(spark, sf_dir).collect(), texts)


def test_defined_cases(odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    rows = media.store_documents(odd_docs).collect()
    check(rows, texts)
    assert len(rows) == odd_docs.count() and media.store_documents(no_docs).count() == 0
    for r in rows:
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])


def test_media_column(odd_docs):
    stored = media.store_documents(odd_docs).select("doc_id", "media", "feature")
    for r in media.media_features(stored).collect():
        assert r["feature"] == f"{r['thumb_width']}x{r['thumb_height']}:{r['thumb_hash']}"


def test_null_and_damaged_media_cost_their_own_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(3)
    good = [bytes(r["media"]) for r in media.store_documents(docs).select("media").collect()]
    rows = [(0, good[0]), (1, None), (2, b""), (3, b"no image"), (4, good[1][:-40]), (5, good[1].replace(b"\xff\xc4", b"\xff\xfe")), (6, good[2])]
    found = {r["id"]: r for r in media.media_features(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert len(found) == len(rows)
    for i in (0, 6):
        assert found[i]["thumb_hash"] and found[i]["media_error"] is None
    for i in (1, 3, 4, 5):
        assert found[i]["thumb_hash"] is None and found[i]["thumb_width"] is None and found[i]["media_error"]
