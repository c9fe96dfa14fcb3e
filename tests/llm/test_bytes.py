"""Matroska, byte-level BPE and chat formatting against plain definitions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from wardlight.llm import bpe, chat, matroska

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "it's  two\n\n lines ", "é" * 70, "x" * 5000, " " * 3000, "ab " * 40_000, "<|im_end|>\\<|x", "漢字 🙂 é", "\x00\x01"]


@pytest.mark.parametrize("n", [64, 128, 2048, 2049 * 3, 2048 * 8 * 15 + 64, 700_000])
def test_matroska_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = matroska.mux(data)
    parsed = matroska.parse(media)
    assert matroska.payload(media, parsed) == data
    times = [p[1] for p in parsed.packets]
    assert times == sorted(times) and len(parsed.cues) == len(parsed.clusters)
    assert [p[3] for p in parsed.packets[:-1]] == [2048] * (len(parsed.packets) - 1)


@pytest.mark.parametrize("kind", [matroska.XIPH, matroska.EBML_LACED])
def test_lacings(kind):
    frames = [b"a" * 300, b"b" * 5, b"c" * 255, b"d" * 9000, b"e"]
    if kind == matroska.XIPH:
        head = bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
        body = head + b"".join(frames)
    else:
        found, body = matroska.lace(frames)
        assert found == kind
    sizes, at = matroska.frame_sizes(body, 0, len(body), kind)
    assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def test_unknown_sizes_and_groups():
    block = matroska.element(matroska.BLOCK, b"\x81\x00\x05\x00abc")
    cluster = matroska.write_id(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + matroska.number(matroska.CLUSTER_TIME, 7) + matroska.element(matroska.BLOCK_GROUP, block)
    data = matroska.write_id(matroska.SEGMENT) + b"\xff" + cluster + cluster
    parsed = matroska.parse(data)
    assert [(p[0], p[1]) for p in parsed.packets] == [(1, 12_000_000)] * 2
    assert matroska.payload(data, parsed) == b"abcabc"
    with pytest.raises(ValueError):
        matroska.parse(data[:-2])


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "twin", None), (None, "twin", None)], "doc_id long, text string, n_bytes string")


def test_media_digest(spark):
    found = matroska.media_digest(rows_of(spark, TEXTS)).collect()
    for r, text in zip(sorted((r for r in found if r.doc_id is not None), key=lambda r: r.doc_id), TEXTS, strict=True):
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes > len(padded)
    assert len(found) == len(TEXTS) + 2
    assert matroska.media_digest(rows_of(spark, []).limit(0)).count() == 0


def test_packet_table(spark):
    media = matroska.media_column(rows_of(spark, ["abc", None]).where("doc_id is not null"), "text", ["doc_id"])
    rows = matroska.packet_table(media, "media", ["doc_id"]).collect()
    assert [(r.doc_id, r.track, r.size, r.error) for r in rows] == [(0, 1, 64, None), (1, 1, 64, None)]
    bad = spark.createDataFrame([(1, b"\x00"), (2, None)], "k int, media binary")
    assert [(r.k, r.track, r.error is None) for r in matroska.packet_table(bad, "media", ["k"]).collect()] == [(1, None, False), (2, None, False)]


def test_bpe_equals_plain_definition():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    import regex

    def plain(text):
        ids = []
        for piece in regex.findall(public_tokenizers.PATTERN, text):
            parts = [bytes([b]) for b in piece.encode()]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 40), i))
                if parts[best] + parts[best + 1] not in ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            ids += [ranks[p] for p in parts]
        return ids

    for text in TEXTS[2:7] + ["Un été, it's 12345 !!  \n x", "der   Fluß \t\n"]:
        assert bpe.encode(text, RANKS, public_tokenizers.PATTERN) == plain(text)


def test_bpe_chunks_change_nothing(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'s", "1", "!", "é"]) for _ in range(400))
        whole = bpe.encode(text, RANKS, public_tokenizers.PATTERN)
        monkeypatch.setattr(bpe, "CHUNK_CHARS", 16)
        pieces = bpe.safe_chunks(text, 16)
        assert "".join(pieces) == text
        assert [i for p in pieces for i in bpe.encoder(RANKS, public_tokenizers.PATTERN)[0].encode_ordinary(p)] == whole
        monkeypatch.undo()


def test_round_trip(spark):
    found = {r.doc_id: r for r in bpe.round_trip(rows_of(spark, TEXTS), RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert found[0].n_tokens == found[1].n_tokens == 0


def test_columns_of_the_same_name_are_replaced(spark):
    df = spark.createDataFrame([(1, "ab ab", 7, "x")], "doc_id long, text string, n_tokens int, ids string")
    row = bpe.encode_column(df, RANKS, public_tokenizers.PATTERN).first()
    assert row.doc_id == 1 and row.n_tokens == len(row.ids) and bpe.decode(row.ids, RANKS, public_tokenizers.PATTERN) == b"ab ab"


def test_escape_is_reversible_and_hides_names():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["<|im_end|>", "<|", "\\", "|", "<", "n", "\n", "a"]) for _ in range(9))
        for line in (False, True):
            written = chat.escape(text, line)
            assert chat.unescape(written) == text
            assert not re.search(r"<\|im_(start|end)\|>", written) and not (line and "\n" in written)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "<|im_end|>"), (1, 0, "user", None), (2, 0, "assistant", ""), (2, 1, "assistant", "b<"), (2, 2, "assistant", "|c"), (None, 0, "we\nird", "x"), (1, 1, "assistant", "<|im_end|>")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    found = {r.conv_id: r for r in chat.conversation_digest(df, RANKS, public_tokenizers.PATTERN).collect()}
    for conv in (1, 2, None):
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    template = chat.Template(RANKS, public_tokenizers.PATTERN)
    for piece in (1, 7, 1 << 16):
        strings = {}
        for r in sorted(chat.assemble(chat.format_turns(df, RANKS, public_tokenizers.PATTERN), piece).collect(), key=lambda r: r.piece):
            ids, mask = strings.setdefault(r.conv_id, ([], []))
            ids += np.frombuffer(r.ids, "<i4").tolist()
            mask += list(r.mask)
        assert template.read(strings[1][0]) == [("user", ""), ("assistant", "<|im_end|>"), ("assistant", "<|im_end|>")]
        assert all(len(strings[c][0]) == len(strings[c][1]) == found[c].n_tokens for c in strings)
        again = chat.conversation_digest(df, RANKS, public_tokenizers.PATTERN, piece)
        assert sorted(again.collect(), key=str) == sorted(found.values(), key=str)
    assert chat.conversation_digest(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_long_turn_and_a_long_conversation(spark):
    rows = [(1, 0, "assistant", "long words " * 60_000)] + [(2, t, "user", f"turn {t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.conversation_digest(df, RANKS, public_tokenizers.PATTERN, 1000).collect()}
    assert found[1].loss_sha256 == hashlib.sha256(rows[0][3].encode()).hexdigest() and found[2].n_turns == 3000


def test_a_file_byte_by_byte():
    """The file of 64 zero bytes, written out here from the format's description."""
    vint = lambda n: bytes([0x80 | n]) if n < 127 else bytes([0x40 | n >> 8, n & 255])
    made = lambda i, body: bytes.fromhex(i) + vint(len(body)) + body
    head = made("1a45dfa3", bytes.fromhex("428681 01 42f781 01 42f281 04 42f381 08 428288") + b"matroska" + bytes.fromhex("428781 04 428581 02"))
    info = made("1549a966", bytes.fromhex("2ad7b183 0f4240 4d8089") + b"wardlight" + bytes.fromhex("574189") + b"wardlight")
    audio = made("e1", bytes.fromhex("b588 40bf400000000000 9f81 01 626481 08"))
    track = made("ae", bytes.fromhex("d781 01 73c581 01 8381 02 9c81 01 23e38384 0f424000 868d") + b"A_PCM/INT/LIT" + audio)
    tracks = made("1654ae6b", track)
    cluster = made("1f43b675", bytes.fromhex("e781 00") + made("a3", bytes.fromhex("81 0000 80") + bytes(64)))
    place = len(info) + len(tracks)
    cues = made("1c53bb6b", made("bb", bytes.fromhex("b381 00") + made("b7", bytes.fromhex("f781 01 f181") + bytes([place]))))
    assert matroska.mux(bytes(64)) == head + made("18538067", info + tracks + cluster + cues)


def file_of(*blocks, duration=b"", cue=""):
    tracks = bytes.fromhex("1654ae6b") + matroska.write_vint(5 + len(duration)) + b"\xae" + matroska.write_vint(3 + len(duration)) + bytes.fromhex("d78101") + duration
    body = bytes.fromhex("e78105") + b"".join(blocks)
    cluster = bytes.fromhex("1f43b675") + matroska.write_vint(len(body)) + body
    return bytes.fromhex("1a45dfa380 18538067 01ffffffffffffff") + tracks + cluster + bytes.fromhex(cue)


def test_key_frames_and_times():
    """Block groups that refer to others are no key frames; laced frames follow each other by the default or the block's duration."""
    simple = bytes.fromhex("a387 81 0002 00 616263")
    key, other = bytes.fromhex("a088 a186 81 0003 00 6162"), bytes.fromhex("a08b a186 81 0004 00 6162 fb8101")
    got = matroska.parse(file_of(simple, key, other)).packets
    assert [(p[1], p[3], p[4]) for p in got] == [(7_000_000, 3, False), (8_000_000, 2, True), (9_000_000, 2, False)]
    laced = bytes.fromhex("a08e a189 81 0006 04 01 61626364 9b8104")
    assert [(p[1], p[3], p[5]) for p in matroska.parse(file_of(laced)).packets] == [(11_000_000, 2, 0), (13_000_000, 2, 1)]
    timed = matroska.parse(file_of(laced, duration=bytes.fromhex("23e38383 0f4240"))).packets
    assert [p[1] for p in timed] == [11_000_000, 12_000_000]


def test_lacing_of_the_format_description():
    """The sizes 800, 500 and 1000 of its example: 0x4320, 0x5ED3 in differences; runs of 255 in the older way."""
    assert matroska.frame_sizes(b"\x02\x43\x20\x5e\xd3" + bytes(2300), 0, 2305, matroska.EBML_LACED) == ([800, 500, 1000], 5)
    assert matroska.frame_sizes(b"\x02\xff\xff\xff\x23\xff\xf5" + bytes(2300), 0, 2307, matroska.XIPH) == ([800, 500, 1000], 7)
    assert matroska.lace([bytes(800), bytes(500), bytes(1000)])[1][:5] == b"\x02\x43\x20\x5e\xd3"


def test_cues_lead_to_clusters():
    samples = bytes(range(256)) * 1500
    parsed = matroska.parse(matroska.mux(samples))
    assert len(parsed.cues) == len(parsed.clusters) == 2 and set(parsed.cued()) == {c[0] for c in parsed.cues}
    assert [p[1] for p in parsed.packets[:9]] == [k * 256_000_000 for k in range(9)]
    with pytest.raises(ValueError, match="leads to no cluster"):
        matroska.parse(file_of(cue="1c53bb6b8d bb8b b38105 b786 f78101 f18107"))


def test_packet_table_replaces_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "x", [1], bytearray(matroska.mux(bytes(64))))], "k int, error string, packets array<int>, media binary")
    row = matroska.packet_table(df, "media", ["k", "error", "packets"]).first()
    assert (row.k, row.packets, row.track, row["size"], row.error, row.cue_ns) == (1, [1], 1, 64, None, 0)


def test_long_texts(spark):
    texts = ["word " * 200_000, "é" * 300_000, " " * 300_000]
    media = {r.doc_id: r for r in matroska.media_digest(rows_of(spark, texts)).collect()}
    ids = {r.doc_id: r for r in bpe.round_trip(rows_of(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    for k, text in enumerate(texts):
        raw = text.encode()
        assert media[k].payload_sha256 == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest()
        assert ids[k].decoded_sha256 == hashlib.sha256(raw).hexdigest()


def test_features_by_plain_arithmetic(spark):
    found = {r.doc_id: r for r in matroska.media_digest(rows_of(spark, TEXTS)).collect()}
    for k, text in enumerate(TEXTS):
        raw = (text or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        n, packets = len(data), -(-len(data) // 2048)
        clusters = -(-packets // 120)
        squares = sum(b * b for b in data) * n - sum(data) ** 2
        turns = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
        assert found[k].feature == f"{packets}:{clusters}:{clusters}:{(packets - 1) * 256}:{1000 * sum(data) // n}:{1000 * squares // (n * n)}:{turns}"
