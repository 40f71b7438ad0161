"""Operators 3, 6, 8: encoders against the libraries, rules against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, quality_rules, token_files
from ledgerloom.llm.common import vocabulary
from ledgerloom.llm.pieces import SpacePieces

ODD = [None, "", " ", "a", "<|endoftext|> a", "x" * 5000, "日本 \x1c é 😀\n\nIt's", "a  b", "\t\n", "The The the"]


def made(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def frame(spark, texts):
    rows = [(k, t, "extra") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (0, "again", "extra"), (None, "no id", "extra")], "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def word_encoder():
    path = vocabulary("word_bpe_49k.json")
    return bpe.encoder(path, bpe.lookahead_of(path)), Tokenizer.from_file(path)


def test_transducer_equals_library(word_encoder):
    ours, theirs = word_encoder
    letters = [*"ab'sÉé \n\t 1,.ñΣİ", "<|endoftext|>", "　", "\x1c", "'ll", "é", "日本", "😀"]
    for text in made(random.Random(1), letters, 3000):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.ids(text) == ids
        state = bpe.Decoder(ours.model, library=True)
        assert state.feed(ids[:2]) + state.feed(ids[2:]) + state.finish() == theirs.decode(ids, skip_special_tokens=False)


def test_streams_equal_library(word_encoder):
    """Texts in blocks that end anywhere: within words, contractions, special strings, composed characters."""
    ours, theirs = word_encoder
    letters = [*"ab'sÉé1.ñΣİ", "<|endoftext|>", "'ll", "e\u0301", "日本", "😀", "\u0301", "<|", "\u1112\u1161\u11ab"]
    rng = random.Random(9)
    for n in range(1500):
        text = "".join(rng.choice(letters if n % 2 else [*letters, " ", "\n", "　"]) for _ in range(rng.randint(0, 200)))
        found = [k for ids in ours.stream(bpe.blocks(text, rng.randint(1, 90)), rng.choice([70, 100])) for k in ids]
        assert found == theirs.encode(text, add_special_tokens=False).ids
    for text in ("x" * 20_000, "'" * 9000, "日本語" * 5000, "a1" * 6000, "a'll" * 4000, "!" * 9000 + "'s"):
        assert ours.ids(text) == theirs.encode(text, add_special_tokens=False).ids


def test_digests_equal_library(spark, word_encoder):
    _, theirs = word_encoder
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    texts = [*ODD, "word " * 40_000, *made(random.Random(11), [*"ab'sÉé \n\t 1,.ñ", "<|endoftext|>"], 60)]
    rows = {r.doc_id: r for r in bpe.round_trip_digests(frame(spark, texts).where("text is null or text <> 'again'"), with_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert (rows[k].n_tokens, rows[k].ids) == (len(ids), ids)
        assert rows[k].ids_sha256 == sha(" ".join(map(str, ids))) and rows[k].decoded_sha256 == sha(theirs.decode(ids, skip_special_tokens=False))


def test_long_words_stream_with_constant_memory(word_encoder):
    ours, theirs = word_encoder
    rng = random.Random(2)
    word = "".join(rng.choice(["th", "e", "an", "ing", "a", "zz", "qu", "er"]) for _ in range(3000))
    run, most, ids = bpe.Transducer(ours.model, 100), 0, []
    for symbol in (ours.model.symbols[b] for b in word.encode()):
        ids += run.feed([symbol])
        most = max(most, len(run.held))
    assert ids + list(run.finish()) == theirs.encode(word, add_special_tokens=False).ids
    assert most <= ours.model.lookahead + 101


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "bc")]) == 2


def test_text_decoding_waits_for_whole_characters(word_encoder):
    ours, _ = word_encoder
    ids = ours.ids("日 é")
    state = bpe.Decoder(ours.model)
    assert "".join(state.feed([k]) for k in ids) + state.finish() == "日 é "


def test_round_trip_query(spark, word_encoder):
    rows = bpe.round_trip_digests(frame(spark, ODD), with_ids=True).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert r.n_tokens == len(r.ids)
    assert bpe.round_trip_digests(frame(spark, ODD).limit(0)).count() == 0


def test_pieces_equal_library():
    ours, theirs = SpacePieces(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    letters = [*"ab'sé \n\t 1,.", "<|endoftext|>", "　", "\x1c", "  ", "\r", "\x85"]
    for text in made(random.Random(3), letters, 3000):
        assert np.frombuffer(ours.encode(text), "<u2").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 100), (1000, 10**9), (200, 1)):
        values = np.sort(rng.integers(0, top, n))
        packed = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
        assert packed.all().tolist() == values.tolist()
        assert all(packed.select(k) == values[k] for k in range(0, n, 7))
    with pytest.raises(IndexError):
        packed.select(200)


def test_token_table(spark, tmp_path):
    texts = ["b c", None, "", "long " * 500, "a", "a"]
    docs = spark.createDataFrame([(k - 3, t) for k, t in enumerate(texts)] + [(None, "z"), (1, "again")], "doc_id long, text string")
    token_files.write_token_table(docs, str(tmp_path / "t"), segment_ids=64)
    rows = token_files.read_token_table(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -3, -2, -1, 0, 1, 1, 2]
    t, at = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    by_id = {r.doc_id: r for r in rows}
    ids = t.encode(texts[3], add_special_tokens=False).ids + [2]
    assert by_id[0].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and by_id[-2].n_tokens == 1
    token_files.write_token_table(docs.limit(0), str(tmp_path / "e"))
    assert token_files.read_token_table(spark, str(tmp_path / "e")).count() == 0


def test_every_document_of_the_token_files(spark, tmp_path):
    """Offsets, counts and checksums of all rows against the library; segments of four-byte ids as well."""
    texts = [*ODD, *made(random.Random(12), [*"ab'sé \n\t 1,.", "long "], 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_token_table(docs, str(tmp_path / "t"), segment_ids=500)
    t, at = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), 0
    for r in token_files.read_token_table(spark, str(tmp_path / "t")).orderBy("doc_id").collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    wide = [np.array(x, "<u4").tobytes() for x in ([70_000, 1], [2], [99_999] * 5)]
    keys, ids, ends = token_files.unpack_segment(token_files.pack_segment([None, 4, 9], wide, 4))
    assert keys == [None, 4, 9] and ids.tolist() == [70_000, 1, 2, *[99_999] * 5] and [ends.select(k) for k in range(3)] == [2, 3, 8]


def repeats_by_hand(words):
    places = {}
    for k in range(len(words) - 4):
        places.setdefault(tuple(words[k : k + 5]), []).append(k)
    return len({j for found in places.values() if len(found) > 1 for k in found for j in range(k, k + 5)})


def test_base_rules_by_hand():
    rng = random.Random(4)
    for _ in range(3000):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
        assert quality_rules.repeated_words(words) == repeats_by_hand(words)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b", "\n", " ", "\x1c", "\xa0", "\t", "cd"]) for _ in range(rng.randint(0, 40)))
        assert quality_rules.words_of(text) == re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, n = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                n += line in seen
                seen.add(line)
        assert quality_rules.duplicate_lines(text) == n


def test_fertility_rejects_noise_and_keeps_text(spark):
    prose = "The quick brown fox jumps over the lazy dog while rain falls on quiet hills and people walk home slowly"
    noise = " ".join("".join(random.Random(k).choice("#$%&*xqzjkv") for _ in range(12)) for k in range(30))
    rows = {r.doc_id: r for r in quality_rules.judge_documents(frame(spark, [prose, noise, None, "a b"])).where("doc_id > 0 or n_words > 5").collect()}
    assert rows[0].kept and not rows[1].kept and not rows[1].base_failed
    assert rows[2].n_words == 0 and rows[2].base_failed and rows[3].base_failed
    assert quality_rules.script_of("Привет мир") == "cyrillic" and quality_rules.script_of("123") == "none"


def test_fertility_equals_libraries():
    """Every measure, word by word, by the libraries themselves."""
    import base64
    import math
    from collections import Counter

    import sentencepiece
    import tiktoken

    paths = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken")
    ours = quality_rules.Fertility(*paths)
    piece = sentencepiece.SentencePieceProcessor(model_file=paths[0])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(paths[1], "rb"))}
    multi = tiktoken.Encoding("m", pat_str=quality_rules.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(14)
    for text in ["plain words here", "Привет мир", "日本語 テスト", "z" * 60_000, *made(rng, [*"ab'sé \n1.,日ж😀"], 200)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        if not words:
            continue
        ids, chars = [k for w in words for k in piece.encode(w)], sum(map(len, words))
        counts = Counter(ids)
        wanted = (len(ids), chars / len(ids), chars / sum(len(multi.encode_ordinary(f" {w}")) for w in words), sum(map(piece.is_byte, ids)) / len(ids), -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values()))
        assert ours.measure(words, chars) == pytest.approx(wanted)


def test_very_long_and_no_documents(spark):
    """A text of two million characters, an empty table, and rows that come twice, through every operator on documents."""
    from ledgerloom.llm import mixing, near_dedup, rule_ensemble, secret_scan, toxicity

    long = "word number one, " * 120_000
    docs = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (2, None, None), (3, "", "a"), (3, "", "a")], "doc_id long, text string, source string")
    toxic, good = toxicity.fit([]), rule_ensemble.Ensemble()
    every = {
        "op1": lambda d: toxicity.score(d, toxic), "op2": lambda d: rule_ensemble.score(d, good), "keep": lambda d: rule_ensemble.keep_good(d, good), "op3": bpe.round_trip_digests, "op4": mixing.mix_documents,
        "op6": quality_rules.judge_documents, "op7": near_dedup.near_duplicates, "op10": secret_scan.scan, "redact": secret_scan.redact_documents,
    }
    for name, run in every.items():
        rows = run(docs).collect()
        assert len(rows) == 5 and len({str(r) for r in rows if r.doc_id == 1}) == len({str(r) for r in rows if r.doc_id == 3}) == 1, name
        assert run(docs.limit(0)).count() == 0, name
