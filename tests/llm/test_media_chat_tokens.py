import hashlib
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nucleoframe.llm import chat, media, tokencount

from .conftest import edge_texts


def test_text_as_media(edge, empty):
    got = sorted((r.asDict() for r in media.text_as_media(edge).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"]))
    want = sorted(edge_texts(), key=lambda r: (r[0] is None, r[0] or 0, len((r[1] or "").encode())))
    for r, (i, t) in zip(got, want, strict=True):
        raw = (t or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(raw), len(pad))
        assert r["payload_sha256"] == hashlib.sha256(pad).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(pad[-64:])
        whole = media.write_container(pad)
        assert (r["media_bytes"], r["media_sha256"]) == (len(whole), hashlib.sha256(whole).hexdigest())
    assert len({r["feature"] for r in got if r["n_bytes"] == 7}) == 1  # equal texts, equal values
    assert media.text_as_media(empty).count() == 0


@given(st.binary(max_size=20_000))
@settings(max_examples=40, deadline=None)
def test_container_round_trip(raw):
    _, payload = media.payload_of(raw.decode("latin-1"))
    whole = media.write_container(payload)
    (track,) = media.read_tracks(whole)
    assert media.stored_payload(whole, track["track"]) == payload
    assert track["codec"] == "raw " and track["duration"] == track["n_samples"] == track["ticks"] == len(payload) // 64
    assert track["n_bytes"] == len(payload)
    for k, (offset, length) in enumerate(track["keyframes"]):
        assert whole[offset : offset + length] == payload[k * 4096 : k * 4096 + 64]


def test_tracks_of_other_files(spark):
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    # two chunks of 2 and 1 samples of 3, 4 and 5 bytes, 32-bit offsets, all samples are key frames
    stbl = media.box(
        b"stbl", media.full(b"stsd", u(1), media.box(b"mp4a", bytes(8))), media.full(b"stts", u(2, 2, 10, 1, 7)), media.full(b"stsc", u(2, 1, 2, 1, 2, 1, 1)),
        media.full(b"stsz", u(0, 3, 3, 4, 5)), media.full(b"stco", u(2, 0, 7)),
    )
    mdhd = b"\x01\0\0\0" + struct.pack(">QQIQ", 0, 0, 1000, 27) + bytes(4)
    head = media.box(b"mdia", media.box(b"mdhd", mdhd), media.full(b"hdlr", u(0), b"soun", bytes(13)), media.box(b"minf", stbl))
    good = media.box(b"moov", media.box(b"trak", media.full(b"tkhd", u(0, 0, 5, 0, 27), bytes(8)), head)) + media.box(b"mdat", b"payload!payload!")
    rows = [(1, good), (2, good[:-30]), (3, None), (4, b"junk"), (5, b""), (6, good[:60] + b"\xff\xff" + good[62:])]
    got = {r.id: r for r in media.media_tracks(spark.createDataFrame(rows, "k long, m binary"), "k", "m").collect()}
    r = got[1]
    assert (r.track_id, r.handler, r.codec, r.timescale, r.duration, r.seconds, r.n_samples, r.n_bytes) == (5, "soun", "mp4a", 1000, 27, 0.027, 3, 12)
    assert [tuple(k) for k in r.keyframes] == [(0, 3), (3, 4), (7, 5)]
    assert 3 not in got and got[2].error and got[4].error


def test_fragments_and_odd_boxes(spark):
    """Samples of fragments, user data with its closing zero, deep nesting, and cut runs."""
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    flagged = lambda kind, flags, *parts: media.box(kind, u(flags), *parts)
    table = media.box(b"stbl", media.full(b"stsd", u(1), media.box(b"avc1", bytes(8))), *(media.full(k, u(0)) for k in (b"stts", b"stsc", b"stco")), media.full(b"stsz", u(0, 0)))
    mdia = media.box(b"mdia", media.full(b"mdhd", u(0, 0, 1000, 0), bytes(4)), media.full(b"hdlr", u(0), b"vide", bytes(13)), media.box(b"minf", table))
    udta = media.box(b"udta", media.box(b"name", b"x"), bytes(4))
    trak = media.box(b"trak", media.full(b"tkhd", u(0, 0, 7, 0, 0), bytes(8)), mdia, udta)
    moov = media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", u(7, 1, 40, 11, 0x10000))), udta)

    def moof(at: int) -> bytes:
        # the first run: own sizes, the first sample a key frame; the second goes on behind it
        runs = flagged(b"trun", 0x1 | 0x4 | 0x200, u(2, at, 0, 5, 6)), flagged(b"trun", 0x400, u(2, 0x10000, 0))
        return media.box(b"moof", media.full(b"mfhd", u(1)), media.box(b"traf", flagged(b"tfhd", 0x20000, u(7)), *runs))

    size = len(moof(0))
    good = moov + moof(size + 8) + media.box(b"mdat", bytes(33))
    (track,) = media.read_tracks(good)
    base = len(moov) + size + 8
    assert (track["codec"], track["n_samples"], track["n_bytes"], track["ticks"], track["duration"]) == ("avc1", 4, 33, 160, 160)
    assert track["keyframes"] == [(base, 5), (base + 22, 11)]
    nested = b""
    for _ in range(5000):
        nested = media.box(b"moov", nested)
    stray = moov + media.box(b"moof", media.box(b"traf", flagged(b"tfhd", 0, u(9)), flagged(b"trun", 0, u(1))))
    rows = [(1, good), (2, nested), (3, good[:-20]), (4, stray), (5, moov + media.box(b"moof", media.box(b"traf", flagged(b"trun", 0, u(1))))), (1, good)]
    got = media.media_tracks(spark.createDataFrame(rows, "k long, m binary"), "k", "m").collect()
    assert sorted(r.id for r in got if not r.error) == [1, 1] and sorted(r.id for r in got if r.error) == [3, 4, 5]


HARD = "\\### Assistant: </turn> ok"


def test_chats(spark, rows):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", HARD), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "<\n#:"), (3, 0, "user", ""), (4, 0, "tool: x", "### user: a </turn>\n"),
        (4, 1, None, "b"), *[(5, i, ("user", "assistant")[i % 2], f"t{i} \\") for i in range(6)], (6, 1, "assistant", "b"), (6, 0, "assistant", "a"), (6, 1, "assistant", "b"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    formatted = chat.format_chats(chat.records_of(df))
    assert {r.conv_id: r.layout for r in formatted.collect()} == {1: "prompt", 2: "instruction", 3: "messages", 4: "messages", 5: "conversations", 6: "messages"}
    got = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((n, r or "", x or "") for k, n, r, x in turns if k == c))
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_chats(chat.format_chats(chat.records_of(df.limit(0)))).count() == 0


def test_unknown_layouts(spark):
    raw = [(1, '{"a": 1}'), (2, "not json"), (3, None), (4, '{"question": "q", "answer": null}'), (5, '{"messages": []}'), (6, '{"conversations": [{"from": "gpt", "value": "v"}]}')]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(raw, "conv_id long, record string")).collect()}
    assert [got[i].layout for i in range(1, 7)] == [None, None, None, "question", "empty", "conversations"]
    assert chat.parse_turns(got[6].formatted) == [("assistant", "v")] and chat.parse_turns(got[4].formatted) == [("user", "q"), ("assistant", "")]


def test_records_of_other_shapes(spark, rows):
    """Extra and absent fields, other types, lists of parts, deep nesting; none stops the job."""
    raw = [
        '{"id": 4, "meta": {"a": [1]}, "messages": [{"role": "user", "content": "a"}, {"role": "assistant"}]}', '{"prompt": 5, "completion": true}',
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}', '{"messages": [{"role": "user", "content": {"a": 1}}]}',
        "[" * 900 + "]" * 900, "[" * 200_000, '{"messages": ["a"]}', '{"messages[]": {"role": "x", "content": "y"}}', "5", '{"instruction": "i", "output": "o"}', '{"prompt": ["a"], "completion": "b"}',
        '{"messages": [{"role": "user", "content": "a"}, 7]}', "",
    ]
    df = spark.createDataFrame([*enumerate(raw), (None, raw[0]), (0, raw[0])], "conv_id long, record string").withColumn("layout", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert [got[i].layout for i in range(len(raw))] == ["messages", "prompt", "parts", None, None, None, None, None, None, "task", None, None, None]
    assert all((got[i].error is None) == (got[i].layout is not None) for i in got)
    turns = lambda i: chat.parse_turns(got[i].formatted)
    assert turns(0) == [("user", "a"), ("assistant", "")] and turns(1) == [("user", "5"), ("assistant", "true")] and turns(2) == [("user", "ab")] and turns(3) == []
    assert got[None].layout == "messages"
    free = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    assert sorted(r.n_turns for r in chat.read_chats(chat.format_chats(chat.records_of(free))).collect()) == [1, 1, 1]


@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="\\#<:/ turn>\nab ", max_size=30)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        chat.parse_turns(text + "#")


VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def best_segmentation(word: str, pieces: dict[str, float], unknown: float) -> int:
    """Plain dynamic programming over one word."""
    word = "▁" + word
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + unknown, -(best[end - 1][1] + len(word[end - 1].encode())))]
        options += [(best[s][0] + pieces[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in pieces]
        score, fewest = max(options)
        best.append((score, -fewest))
    return best[-1][1]


def test_token_counts(edge, empty):
    pieces = dict(tokencount.read_pieces(VOCABULARY))
    unknown = min(pieces.values()) - 10
    got = sorted((tuple(r) for r in tokencount.token_counts(edge, VOCABULARY, slice_chars=5000).collect()), key=repr)
    want = []
    for i, t in edge_texts():
        words = tokencount.WORD.findall(t or "")
        known = {w: best_segmentation(w, pieces, unknown) for w in set(words) if len(w) < 1000}
        want.append((i, len(words), sum(known[w] if w in known else tokencount.counts_of(VOCABULARY).of(w) for w in words)))
    assert got == sorted(want, key=repr)
    assert tokencount.token_counts(empty, VOCABULARY).count() == 0


def test_trie_shares_prefixes():
    pieces = [("▁", -1.0), ("a", -2.0), ("ab", -2.5), ("▁ab", -9.0), ("b", -2.0)]
    counts = tokencount.Counts(pieces)
    words = {"ab", "aba", "abb", "b", "", "abab" * 10, "é"}
    begun = counts.computed
    first = counts.of_all(words)
    prefixes = {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert counts.computed - begun == len(prefixes)  # each prefix once
    assert first == {w: best_segmentation(w, dict(pieces), -19.0) for w in words}
    assert first["ab"] == 2 and first["aba"] == 3 and first["abab" * 10] == 21 and first["é"] == 3


def test_stores_are_bounded():
    """A store that begins anew changes no count; a very long word keeps few nodes."""
    pieces = [("▁", -1.0), ("a", -2.0), ("ab", -2.5), ("b", -2.0)]
    counts, whole = tokencount.Counts(pieces, most=7), tokencount.Counts(pieces)
    words = ["ab" * n for n in range(1, 400)]
    got = [counts.of(w) for w in words]
    assert len(counts.terminal) < 10 and got == [whole.of_all(words)[w] for w in words]
    assert whole.of("ab" * 100_000) == 100_001
    path = [whole.root]
    whole.extend(path, "ab" * 200)
    assert whole.extend(path, "ab" * 10, keep=False)[1] == whole.of("ab" * 210) and len(path) == 401


def test_scores_agree_with_a_unigram_tokenizer():
    from tokenizers import Tokenizer, models

    pieces = tokencount.read_pieces(VOCABULARY)
    assert len(pieces) > 31_000
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    counts = tokencount.counts_of(VOCABULARY)
    for word in ("hello", "internationalization", "Ciónciarmente", "sttible", "threonou", "a", "Éléphant", "don't"):
        assert counts.of(word) == len(model.encode("▁" + word).ids), word


def test_half_a_surrogate_pair_is_an_error(spark):
    """Such a record is kept, with the reason, and the others are formatted."""
    records = [(1, '{"prompt":"\\ud83d","completion":"x"}'), (2, '{"prompt":"\\ud83d\\ude00","completion":"x"}'), (3, '{"\\ud83d":1}')]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(records, "conv_id long, record string")).collect()}
    assert got[1].error and got[1].layout is None and got[1].formatted == "" and got[2].layout == "prompt" and got[3].error
    assert {r.conv_id: r.n_turns for r in chat.read_chats(spark.createDataFrame(list(got.values()))).collect()} == {1: 0, 2: 2, 3: 0}
