"""Cases at the edge of formats and blocks that small tables don't reach."""

import struct

import numpy as np
import pytest

from panelwalk.llm import jaccard_join, mpeg_audio, substring_dedup


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_anchors_of_texts_beyond_a_block(monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    anchors = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    anchors[50:120] = anchors[40]  # ties: the leftmost counts
    reach = substring_dedup.REACH
    high = anchors & ~substring_dedup._PLACE
    wanted = [i + int(np.argmin(high[i : i + reach])) for i in range(len(anchors) - reach + 1)]
    assert substring_dedup._leftmost(anchors).tolist() == wanted


def frame(head, size):
    return bytes(head) + bytes(size - 4)


@pytest.mark.parametrize(("head", "size", "rate", "samples"), [
    ((0xFF, 0xFB, 0x90, 0x00), 417, 44100, 1152),  # MPEG-1, 128 kbit/s
    ((0xFF, 0xF3, 0x80, 0x00), 208, 22050, 576),  # MPEG-2, 64 kbit/s
    ((0xFF, 0xE3, 0x80, 0x00), 417, 11025, 576),  # MPEG-2.5, 64 kbit/s
    ((0xFF, 0xFB, 0x92, 0x00), 418, 44100, 1152),  # with the padding byte
])
def test_headers_of_all_versions(head, size, rate, samples):
    assert mpeg_audio.header(bytes(head), 0)[:1] == (size,)
    junk = b"\xff\xfb junk before \xff"
    x = mpeg_audio.read_mpeg(junk + frame(head, size) * 3)
    assert (x["samples"], x["rate"], len(x["places"]), x["skipped"]) == (3 * samples, rate, 3, len(junk))
    assert x["places"] == [len(junk) + i * size for i in range(3)]


def test_reserved_headers_are_none():
    for head in ((0xFF, 0xEB, 0x90, 0), (0xFF, 0xFD, 0x90, 0), (0xFF, 0xFB, 0xF0, 0), (0xFF, 0xFB, 0x00, 0), (0xFF, 0xFB, 0x9C, 0), (0xFE, 0xFB, 0x90, 0)):
        assert mpeg_audio.header(bytes(head), 0) is None
    assert mpeg_audio.header(b"\xff\xfb\x90", 0) is None


def test_vbri_table_is_no_audio_frame():
    head = (0xFF, 0xFB, 0x90, 0x00)
    first = bytearray(frame(head, 417))
    first[36:54] = b"VBRI" + struct.pack(">HHHII", 1, 0, 75, 3 * 417, 2)
    x = mpeg_audio.read_mpeg(bytes(first) + frame(head, 417) * 2 + b"TAG" + bytes(125))
    assert (x["table"], x["table_frames"], len(x["places"]), x["tags"]) == ("VBRI", 2, 2, ["ID3v1"])


def test_a_very_long_text_and_its_near_copy_are_linked(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 5000, 250_000)]
    near = list(words)
    for i in rng.integers(0, len(words), 2000).tolist():
        near[i] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:100]))], "doc_id long, text string")
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (words, near)]
    linked = 100 * len(sets[0] & sets[1]) >= 90 * len(sets[0] | sets[1])
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_join.links(docs, n=3, share=90).collect()}
    assert linked and got[1] == (1, len(sets[0])) and got[2] == (1, len(sets[1])) and got[3][0] == 3
