"""Operators 4, 7, 9, 10 and the pipeline: brute force, round trips, odd rows."""

import base64
import hashlib
import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, mixing, near_dedup, secret_scan
from ledgerloom.llm import secret_scan as S


def water_fill(sizes):
    total, active, targets = sum(sizes.values()), set(sizes), {}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    rest = total
    while active:
        w = sum(weight[s] for s in active)
        over = [s for s in active if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return targets | {s: rest * weight[s] / w for s in active}
        for s in over:
            targets[s] = 3 * sizes[s]
            active.discard(s)
        rest = total - sum(targets.values())
    return targets


def mix_rows(n=400):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "c", None, "é"]), "x") for k in range(n)]
    return [*rows, (1, None, "a", "x"), (None, "w w", "b", "x"), (2, "w w w", "zz", "x"), (2, "w w w", "zz", "x")]


def test_mixing_targets_and_words(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    found = mixing.mix_documents(docs.drop("size")).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = water_fill(sizes)
    assert {round(r.target, 6) for r in found} == {round(v, 6) for v in wanted.values()}
    taken = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        taken[round(r.target, 6), r.source_size] = taken.get((round(r.target, 6), r.source_size), 0) + r.taken
    for s, size in sizes.items():
        if size > 100:
            assert abs(taken[round(wanted[s], 6), size] - wanted[s]) <= 20
    again = mixing.mix_documents(docs.drop("size").repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_mixed_rows(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string, size string")
    out = mixing.sample_documents(docs)
    assert out.columns == docs.columns
    plan = mixing.mix_documents(docs).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == plan


def pareto_by_hand(rows, wanted):
    """words taken of each row: (source, size, u, tie) with targets by source."""
    taken = {}
    for source, target in wanted.items():
        mine = [(k, size, u, tie) for k, (s, size, u, tie) in enumerate(rows) if s == source]
        low, high, base = 0.0, 3.0, math.floor(target / max(1, sum(size for _, size, _, _ in mine)) + 1e-12)
        short = target - base * sum(size for _, size, _, _ in mine)
        root = lambda size: int(1024 * math.sqrt(size))
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(1, c * root(size)) * size for _, size, _, _ in mine) < short else (low, c)
        ranks, lacking = [], target
        for k, size, u, tie in mine:
            e = base + (min(1, high * root(size)) if short > 0 else 0)
            copies = math.floor(e + 1e-9)
            p = e - copies
            taken[k] = copies * size
            lacking -= copies * size
            if p > 1e-9:
                ranks.append((u / (1 - u) / (p / (1 - p)), tie, k, size))
        groups = {}
        for q, tie, k, size in ranks:
            groups.setdefault((q, tie), []).append((k, size))
        got = 0
        for group in sorted(groups):
            words = sum(size for _, size in groups[group])
            if lacking <= 0 or got >= lacking or abs(got + words - lacking) > abs(got - lacking):
                break
            got += words
            for k, size in groups[group]:
                taken[k] += size
    return [taken[k] for k in range(len(rows))]


def test_mixing_by_hand(spark):
    """Certain copies and the Pareto sample, row by row; extra columns clash with the operator's own."""
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 30, 31, 32, 200, 900])), rng.choice(["a", "b", "b", "b", "c", None]), 1.0, 2) for k in range(700)]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, source string, p double, size int")
    u = mixing.uniform(F.col("doc_id"), F.col("h"), F.col("n"))
    tie = F.xxhash64(F.lit(mixing.SEED + 1), "doc_id", "h", "n")
    keys = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("n"), F.xxhash64("text").alias("h")).select("doc_id", "source", "n", u.alias("u"), tie.alias("tie")).collect()
    sizes = {}
    for r in keys:
        sizes[r.source] = sizes.get(r.source, 0) + r.n
    wanted = pareto_by_hand([(r.source, r.n, r.u, r.tie) for r in keys], water_fill(sizes))
    found = {}
    for r in mixing.mix_documents(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.taken)
    assert found == {r.doc_id: {t} for r, t in zip(keys, wanted)}
    assert len({r.taken / r.size for r in mixing.mix_documents(docs).where("source_size > 0 and size > 0").select("taken", "size").collect()}) > 2


def near_copies():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [*texts, texts[0], texts[0].upper(), "", None, "one two", "One  two", "x y z", "  "]


def by_hand(rows, size, percent=80):
    sets = {}
    for k, text in rows:
        w = (text or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = {k: low if v == high else v for k, v in root.items()}
                    changed = True
    return {k: len(s) for k, s in sets.items()}, root


@pytest.mark.parametrize("blocks", [3000, 3])
def test_near_duplicates_by_hand(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dedup, "BLOCK", blocks)
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", blocks)
    rows = list(enumerate(near_copies()))
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")
    found = near_dedup.near_duplicates(docs.drop("node")).collect()
    sizes, root = by_hand(rows, 4)
    assert {r.doc_id: r.n_shingles for r in found} == sizes
    assert {r.doc_id: r.component_id for r in found} == root
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_families_are_shuffled_once(spark, monkeypatch):
    """Texts of a large family are alike: a first round settles them, and no set goes to several tasks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(120)]
    texts = []
    for k in range(400):
        words = list(base)
        words[rng.randrange(120)] = f"w{k}"
        texts.append(" ".join(words))
    shipped = []
    between = near_dedup.links_between
    monkeypatch.setattr(near_dedup, "links_between", lambda rows: (shipped.append(rows.count()), between(rows))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {0}
    assert not shipped
    # a chain: most neighbours link, ends don't, so a second round has something to do
    chain = [" ".join(base[k : k + 60]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    _, root = by_hand(list(enumerate(chain)), 4)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == root


def test_one_of_each_group_stays(spark):
    rows = [*enumerate(near_copies()), (0, near_copies()[0]), (None, near_copies()[0]), (3, "another text under a known id")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, kept string")
    out = near_dedup.keep_one(docs, 5)
    _, root = by_hand(list(enumerate(near_copies())), 5)
    ids = [r.doc_id for r in out.where("doc_id is not null").collect()]
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 1
    assert ids.count(0) == 1 and {k for k, v in root.items() if k == v} <= {*ids}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_other_texts_of_an_id_stay(spark):
    """A doc_id whose one text goes as a copy keeps another, alone or least of a group of its own."""
    a, b, c, d = ("alpha beta gamma delta epsilon", "quite another text stands here", "third of the texts in here", "last one of them all today")
    rows = [(1, a), (3, a.upper()), (3, b), (4, a), (4, c), (9, c), (9, d), (5, None), (None, a)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, text_hash string")
    out = near_dedup.keep_one(docs, 5)
    found = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(found, key=str) == sorted([(1, a), (3, b), (4, c), (9, d), (5, None), (None, a)], key=str)


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        values = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
        n = int(len(values) * (1 + share) / 2)
        a, b = values[:n], values[len(values) - n :]
        regs = near_dedup.sketches([a, b, np.union1d(a, b)])
        assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
        more, less = np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()])
        grid, _ = near_dedup.log_likelihood(more, less, np.array([float(len(a))]), np.array([float(len(b))]))
        assert abs(near_dedup.GRID[grid[0].argmax()] - share) < 0.12


CONTROL = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "a", "\n", "[", "<", "/", "s>", "INST]", " ", "é"]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(k // 3, k % 3, rng.choice(["user", "assistant", "sys\ntem", "", None, "a</s>"]), None if k % 50 == 0 else "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 8)))) for k in range(900)]
    rows += [(None, None, "user", "no id"), (5, 1, "assistant", "a tie"), (6, 0, "user", "twice"), (6, 0, "user", "twice")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat.format_conversations(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), "formatted", "loss_spans").collect()}
    assert len(found) == 301
    for conv in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        got = found[conv]
        assert [(t.role, t.text) for t in got.turns] == [(r, x) for _, r, x in mine]
        masked = "".join(re.sub(r"(?s)\\(.)", r"\1", got.formatted[s.start : s.start + s.length]) for s in got.loss_spans)
        assert masked == "".join(x for _, r, x in mine if r == "assistant")
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_digests_by_hand(spark):
    """Every digest against the source; the loss is read through the mask, so a wrong mask shows."""
    rng = random.Random(15)
    rows = [(k // 4, k % 4, rng.choice(["user", "assistant"]), rng.choice([None, "x" * 5000, "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 9)))])) for k in range(400)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for r in chat.read_back(made).collect():
        mine = [(role, text or "") for c, _, role, text in rows if c == r.conv_id]
        loss = "".join(x for role, x in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (4, sha("".join(f"{a}\n{x}\n" for a, x in mine)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    shifted = made.withColumn("loss_spans", F.expr("transform(loss_spans, s -> named_struct('byte_start', s.byte_start, 'byte_length', s.byte_length + 1))")).where("size(loss_spans) > 0")
    assert chat.read_back(shifted).exceptAll(chat.read_back(made)).count() == shifted.count() > 50


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 + (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def rsa_key():
    rng = random.Random(6)
    number = lambda n: der(2, bytes([1]) + rng.randbytes(n))
    return der(0x30, der(2, b"\0") + b"".join(number(30) for _ in range(8)))


def ssh_key():
    part = lambda b: len(b).to_bytes(4, "big") + b
    return S.SSH_MAGIC + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(b"public") + part(b"private")


def kinds(text):
    return [k for _, k, _ in S.added_spans(text)]


def test_structure_is_confirmed():
    key, coded = rsa_key(), base64.b64encode(rsa_key()).decode()
    assert kinds(f"key {coded} end") == ["der_key"]
    assert kinds(f"key {key.hex()} end") == ["der_key"]
    assert kinds(f"key {base64.b64encode(ssh_key()).decode()} end") == ["ssh_key"]
    assert kinds(f"x -----BEGIN RSA PRIVATE KEY-----\n{coded[:64]}\n{coded[64:]}\n-----END RSA PRIVATE KEY----- y")[0] == "pem_key"
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    assert kinds(f"t {head}.eyJhIjoxfQ.abc") == ["jwt"]
    broken = base64.b64encode(key[:-3]).decode()
    assert kinds(f"key {broken} end") == [] and kinds("M" + "A" * 60) == []
    assert kinds("eyJhbGciOjF9.eyJhIjoxfQ.abc") == []  # alg is no string


def test_keys_behind_signs():
    """A key may stand right behind an assignment, a parameter, a path or 0x."""
    key = rsa_key()
    coded, ssh = base64.b64encode(key).decode(), base64.b64encode(ssh_key()).decode()
    for front in ("PRIVATE_KEY=", "https://a.example/b?k=", "?data==", "/My/keys/", "id-", "my_key_", "a+"):
        for secret, kind in ((coded, "der_key"), (ssh, "ssh_key")):
            at = len(front)
            assert S.added_spans(f"{front}{secret}") == [(at, kind, at + len(secret))], front
            assert S.redact(f"{front}{secret} end") == f"{front}[{kind.upper()}] end"
    for front in ("0x", "0X", "k=0x"):
        assert S.added_spans(f"{front}{key.hex()}") == [(len(front), "der_key", len(front) + 2 * len(key))]
    assert kinds(f"KEY={base64.b64encode(key[:-3]).decode()}") == [] and kinds(f"0x{key[:-3].hex()}") == []


def test_every_run_is_decoded():
    """Escaped line ends in PEM blocks; access ids and PEM headers anywhere in what is encoded."""
    coded, code = base64.b64encode(rsa_key()).decode(), lambda b: base64.b64encode(b).decode()
    for end in (r"\n", r"\r\n", r"\\n"):
        text = f'{{"private_key": "-----BEGIN PRIVATE KEY-----{end}{coded[:64]}{end}{coded[64:]}{end}-----END PRIVATE KEY-----{end}"}}'
        assert ("pem_key", text[:17] + "[PEM_KEY]" + end + '"}') == (kinds(text)[0], S.redact(text))
    headed = rf"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,PLAIN\n\n{coded}\n-----END RSA PRIVATE KEY-----"
    assert kinds(headed) == ["pem_key"]
    access, pem = b"AKIA" + b"ABCDEFGH12345678", b"-----BEGIN PRIVATE KEY-----\n" + coded[:40].encode()
    for inside in (access, b"aws_access_key_id=" + access, b"\n" + pem, b"a" + pem, b"\xff\x00" + access + b"\x00"):
        for secret, fronts in ((code(inside), ("key ", "K=")), (inside.hex(), ("key ", "0x")), (inside.hex().upper(), ("K=", "0X"))):
            for front in fronts:
                assert S.added_spans(front + secret) == [(len(front), "encoded", len(front) + len(secret))]
        assert kinds("x" + code(inside)) == ["encoded"]  # shifted by one
    assert S.added_spans("a/bc/" + code(access)) == [(5, "encoded", 5 + len(code(access)))]
    assert kinds(code(b"aws_access_key_id=AKIA12345")) == [] and kinds(code(bytes(range(200)))) == []


def pkcs8(inner):
    return der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, inner))


def test_keys_inside_and_over_lines():
    """Keys at any place of what is encoded, wrapped keys, the inside of PKCS #8, claims of tokens."""
    code = lambda b: base64.b64encode(b).decode()
    for key in (rsa_key(), pkcs8(rsa_key()), pkcs8(der(4, bytes(32)))):
        assert kinds(f"key {code(key)} end") == ["der_key"]
        for front in (b"x", b"xy", b"xyz", b"some bytes "):
            assert kinds(f"k={code(front + key + b'tail')}") == ["encoded"]
            assert kinds(f"k={(front + key + b'tail').hex()}") == ["encoded"]
    assert kinds(f"key {code(pkcs8(rsa_key()[:-2]))} end") == [] and kinds(f"key {code(pkcs8(bytes(40)))} end") == []
    coded = code(rsa_key())
    for end in ("\n", "\r\n", r"\n", r"\\n"):
        for width in (64, 76):
            lines = end.join(coded[k : k + width] for k in range(0, len(coded), width))
            assert S.added_spans(f"k: {lines} z") == [(3, "der_key", 3 + len(lines))], (end, width)
    assert kinds("\n".join([coded[:64], coded[64:120], coded[120:184]])) == []
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    assert kinds(f"t {head}.bm90anNvbg.abc") == [] and kinds(f"t {head}.eyJhIjoxfQ.abcde") == []


def test_keys_as_files_and_code_write_them():
    """Indented, quoted and joined lines, hex over lines and with colons, base64 of base64."""
    key, code = rsa_key(), lambda b: base64.b64encode(b).decode()
    for raw, kind in ((key, "der_key"), (ssh_key() + b"", "ssh_key")):
        coded, digits = code(raw), raw.hex()
        cut = lambda x, n: [x[k : k + n] for k in range(0, len(x), n)]
        pairs = ":".join(cut(digits, 2))
        forms = [
            "key: |\n" + "".join(f"    {x}\n" for x in cut(coded, 64)),
            "k = " + " +\n    ".join(f'"{x}"' for x in cut(coded, 60)) + ";",
            "k = [\n" + "".join(f"  '{x}',\r\n" for x in cut(coded, 64)) + "]",
            "k = " + ' \n  + '.join(f'"{x}\\n"' for x in cut(coded, 60)),
            "export K=" + "\\\n".join(cut(coded, 50)),
            "\n".join(cut(digits, 64)), "x:\n" + "\n".join(f"  {x}" for x in cut(digits.upper(), 40)),
            pairs, "\n".join(cut(pairs, 45)), "key:\n" + "".join(f"    {x}\n" for x in cut(pairs, 60)),
        ]
        for text in forms:
            assert kind in kinds(text), text
            assert kinds(text.replace(coded[10:14], "AAAA").replace(digits[20:28], "00000000").replace(digits[20:28].upper(), "00000000").replace(pairs[30:41], "00:00:00:00")) != [kind] or text.count(coded[10:14]) == 0
    for n in (1, 2):
        nested = key
        for _ in range(n):
            nested = code(nested).encode()
        assert kinds(f"k={code(nested)}") == ["encoded"]
    wrapped = code(b"-----BEGIN PRIVATE KEY-----\n" + code(key).encode())
    assert "encoded" in kinds("\n".join(wrapped[k : k + 76] for k in range(0, len(wrapped), 76)))
    quoted = '"-----BEGIN PRIVATE KEY-----\\n" +\n' + "".join(f'  "{code(key)[k : k + 64]}\\n" +\n' for k in range(0, len(code(key)), 64)) + '  "-----END PRIVATE KEY-----"'
    assert kinds(quoted) == ["pem_key"]
    pem = f"-----BEGIN PRIVATE KEY-----\n{code(key)}\n-----END PRIVATE KEY-----"
    assert kinds("-----BEGIN PRIVATE KEY-----\n" + pem) == ["pem_key"] and S.added_spans(pem + pem) == [(0, "pem_key", len(pem)), (len(pem), "pem_key", 2 * len(pem))]
    assert kinds(":".join(["00", "1a"] * 40)) == [] and kinds("some words\nin lines\n" * 40) == []


HOSTILE = {
    "begins": lambda n: "-----BEGIN PRIVATE KEY-----" * (n // 27) + "-----END PRIVATE KEY-----", "letters": lambda n: "A" * n, "hex": lambda n: "0a" * (n // 2), "backslashes": lambda n: "\\" * n, "signs": lambda n: "M/" * (n // 2),
    "short lines": lambda n: "A\n" * (n // 2), "lines": lambda n: ("A" * 40 + "\n") * (n // 41), "steps": lambda n: "\n".join("A" * (20 + i % 3) for i in range(n // 22)), "starts": lambda n: base64.b64encode(b"\x30\x82\xff\xff\x02\x01\x00" * (n * 3 // 28)).decode(),
    "pairs": lambda n: "00:" * (n // 3), "blanks": lambda n: ('"' + " " * 50) * (n // 51), "ends": lambda n: "M" * 30 + "\n" * n, "tokens": lambda n: "eyJhbGciOiJI." * (n // 13), "escaped": lambda n: ("A" * 20 + "\\n" * 3) * (n // 26),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_text_alone(name):
    took = []
    for n in (250_000, 1_000_000):
        text, began = HOSTILE[name](n), time.process_time()
        S.base_spans(text), S.added_spans(text)
        took.append(time.process_time() - began)
    assert took[1] < max(8 * took[0], 0.5) and took[1] < 5


def test_added_spans_by_hand():
    """Every way to cut a text is decoded by hand; whole keys found so are those that are reported."""
    rng, key = random.Random(21), der(0x30, der(2, b"\1") + der(4, bytes(range(32))))
    coded = base64.b64encode(key).decode()
    for _ in range(300):
        parts = [rng.choice([" ", "=", "-", "word", "é", "M", "MII", coded, coded[:-4], "\n"]) for _ in range(rng.randint(1, 5))]
        text = "".join(parts)
        by_hand = set()
        for a in range(len(text)):
            if a and text[a - 1].isascii() and text[a - 1].isalnum():
                continue
            b = a
            while b < len(text) and re.match(r"[A-Za-z0-9+/_-]", text[b]):
                b += 1
            while b < len(text) and text[b] == "=" and b - a < len(text[a:].rstrip()) and b < a + len(text[a:b].rstrip("=")) + 2:
                b += 1
            raw = S.from_base64(text[a:b])
            if b - a >= 24 and raw == key:
                by_hand.add((a, "der_key", b))
        assert by_hand <= set(S.added_spans(text))
        assert all(S.whole_key(S.from_base64(text[a:b].replace("\n", ""))) for a, kind, b in S.added_spans(text) if kind == "der_key")


def base_by_hand(text):
    found = []
    for kind, pattern, least in (("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)):
        found += [(m.start(), S.ORDER[kind], kind, m.end()) for m in re.finditer(pattern, text) if len(m[2] if kind == "assign" else m[0]) >= least]
    return [(a, k, e) for a, _, k, e in sorted(found)]


def test_base_spans_by_hand():
    rng = random.Random(7)
    parts = ["password", "TOKEN", "api_key", "secret", ":", "=", " ", "'", '"', "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "é", "-", "x", "0" * 16]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert S.base_spans(text) == base_by_hand(text)


def test_scan_and_redaction(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefghijkl ok", 5, "x"), (2, None, None, "x"), (None, "", 0, "x"), (1, "plain", 5, "x")], "doc_id long, text string, n_chars long, spans string")
    rows = secret_scan.scan(docs).collect()
    assert [(r.n_assign, r.spans) for r in rows][0] == (1, "assign:2:20") and len(rows) == 4
    out = secret_scan.redact_documents(docs).collect()
    assert [r.text for r in out] == ["é [ASSIGN] ok", None, "", "plain"] and [r.n_chars for r in out] == [13, None, 0, 5]
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_pipeline_by_hand(spark):
    """Each stage of the pipeline against what it should do to its own input."""
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] and len(P.STAGES) == 5
    good = P.cut(P.quality(spark, docs, folder), "good")
    assert good.columns == docs.columns and good.exceptAll(docs).isEmpty()
    single = P.cut(P.dedup(spark, good, folder), "single")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    _, root = by_hand(rows, P.SHINGLE)
    assert {r.doc_id for r in single.collect()} == {k for k, v in root.items() if k == v}
    clean = P.cut(P.secrets(spark, single, folder), "clean")
    assert {r.doc_id: r.text for r in clean.collect()} == {r.doc_id: S.redact(r.text) for r in single.collect()}
    mixed = P.cut(P.mix(spark, clean, folder), "mixed")
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().exceptAll(clean.select("doc_id")).isEmpty()
    assert P.encode(spark, mixed, folder).count() == mixed.count() > 0
    assert P.quality(spark, docs.limit(0), folder).count() == 0


def test_pipeline_takes_clashing_columns(spark, tmp_path):
    """run() as a whole, on documents whose extra columns are called as the operators' own."""
    import shutil

    import corpus_pipeline as P

    folder = tmp_path / "d"
    folder.mkdir()
    shutil.copy("/root/testdata/sf0.001/labels.parquet", folder / "labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name in ("y", "s", "size", "node", "score", "target", "p", "half"):
        docs = docs.withColumn(name, F.lit(1))
    docs.write.parquet(str(folder / "documents.parquet"))
    found = P.run(spark, str(folder)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    plain = P.run(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(str, found)) == sorted(map(str, plain)) and len(found) > 20
    texts = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, str(folder)), "s")
        texts = [r.text for r in docs.collect()]
        assert len(docs.columns) == 13, name
    from tokenizers import Tokenizer

    from ledgerloom.llm.common import vocabulary

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert sorted(r.n_tokens for r in found) == sorted(len(t.encode(x or "", add_special_tokens=False).ids) for x in texts)
