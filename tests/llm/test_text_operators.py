import hashlib
import json
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from tidemark.llm import bpe, licenses, packing, quality_rules
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- byte-level BPE ------------------------------------------------------------------------------


def merged(ranks, piece):
    """Merge the neighbouring pair of lowest rank until none has one."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_bpe_equals_brute_force_merges(spark):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect()}
    split = regex.compile(public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in QUERIES["op3_bpe"](spark, SF).collect()}
    assert len(got) == 200
    for i, text in texts.items():
        ids = [x for piece in split.findall(text) for x in merged(ranks, piece.encode())]
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_parts_do_not_change_ids():
    e = bpe.encoding()
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(["a", "word", "'s", " ", "  ", "\n", "\t", "1", "é", "日", "!?", "\u00a0", "\r\n"], k=60))
        assert bpe.encode(e, text, size=7).tolist() == e.encode_ordinary(text)


def test_bpe_awkward_rows(awkward):
    rows = bpe.round_trip(awkward).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == awkward.count()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, empty, empty)}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(bpe.encode_documents(awkward)).collect()}
    assert back[7] == "\x00 naïve 日本語 🙂 \u2028 x".encode()
    assert back[8] == b"x" * 200_000
    assert bpe.round_trip(awkward.limit(0)).collect() == []


def test_bpe_decodes_ids_that_are_not_utf8(spark):
    e = bpe.encoding()
    half = e.encode_single_token(b"\xc3")
    assert bpe.decode(e, np.array([half], dtype="<u4")) == b"\xc3"


# --- quality rules -------------------------------------------------------------------------------


def rules_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


def test_quality_rules_equal_brute_force(spark, docs):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(["a ", "b ", "the ", "c\n", "\n", "#", "x\t", "| ", "\x0b", "é "], k=rng.randint(0, 80)))) for i in range(150)]
    rows += [(900, None), (901, "one two three four five one two three four five"), (902, "a a a a a a a"), (903, "1 2 3 4 5")]
    got = {r.doc_id: r for r in quality_rules.judge(docs(rows)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_by_hand(text), text
        assert not (r.kept and r.base_failed)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_quality_rules_keep_labelled_good_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed)
    assert sum(r.kept for r in rows if labels.get(r.doc_id) == 0) < 0.5 * sum(v == 0 for v in labels.values())


def test_quality_rules_run_without_user_functions(spark, awkward):
    judged = quality_rules.judge(awkward)
    assert judged.count() == awkward.count()
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()


# --- license scans -------------------------------------------------------------------------------


def places_by_hand(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


def test_license_places_equal_brute_force(spark, docs):
    rng = random.Random(3)
    parts = ["under", "the", "MIT", "License", "apache", "version", "2", "cc", "by", "nc", "by-nc", "x", "é", "mit license", "under the mit license"]
    rows = [(i, " ".join(rng.choices(parts, k=40))) for i in range(200)] + [(900, None), (901, ""), (902, "Under-The(MIT)\nlicense CC BY NC 4.0")]
    got = {r.doc_id: r for r in licenses.scan(docs(rows)).collect()}
    for i, text in rows:
        assert (got[i].n_words, [(p.start, p.label) for p in got[i].places]) == places_by_hand(text)


def test_license_labels(docs):
    texts = [(1, "x " * 500 + "This work is licensed under the GNU General Public License, version 3. " + "y " * 500), (2, "Released under the MIT License."), (3, "general words of a licence version"), (4, "This is free and unencumbered software released into the public domain")]
    rows = {r.doc_id: r for r in licenses.digest(licenses.scan(docs(texts))).collect()}
    assert (rows[1].labels, rows[1].base_labels, rows[1].score > 0.9) == ("gpl-3", "", True)
    assert (rows[2].labels, rows[2].n_base, rows[2].first_word, rows[2].last_word, rows[2].score) == ("mit", 1, 1, 1, 1.0)
    assert (rows[3].labels, rows[3].first_word, rows[3].score) == ("", None, 0.0)
    assert rows[4].labels == "unlicense"


def alignments_by_hand(index, words):
    out = []
    for (label, phrase, text), weight in zip(index.templates, index.weights, strict=True):
        for start in range(-len(text), len(words)):
            window = words[max(0, start) : max(0, start + len(text))]
            covered = sum(index.idf[w] for p, w in enumerate(text) if 0 <= start + p < len(words) and words[start + p] == w) / weight
            if covered >= licenses.COVERED and any(window[i : i + len(phrase)] == phrase for i in range(len(window))):
                out.append((label, max(0, start), covered))
    return sorted(out)


def test_license_labels_of_several_notices_and_of_long_texts(docs):
    mit, isc, bsd = (next(t for label, p, t in licenses.TEMPLATES if (label, p.split()[0]) == x) for x in (("mit", "permission"), ("isc", "permission"), ("bsd", "redistribution")))
    ordinary = "affero mozilla unencumbered creative commons attribution dedicated international copying work terms subject public domain "
    texts = [(1, f"{mit}. {isc}. {bsd}."), (2, ordinary * 3000 + "released under the bsd license " + ordinary * 3000), (3, " ".join(t for *_, t in licenses.TEMPLATES))]
    texts += [(i, "released under the bsd license") for i in range(4, 9)]
    rows = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(docs(texts))).collect()}
    assert rows[1] == "bsd,isc,mit"
    assert {rows[i] for i in (2, 4, 5, 6, 7, 8)} == {"bsd"}
    assert rows[3] == ",".join(sorted({label for label, *_ in licenses.TEMPLATES}))


def test_license_bodies_are_told_apart(docs):
    gnu = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    texts = [(1, gnu.format("program", "", "3")), (2, gnu.format("program", "", "2")), (3, gnu.format("library", "Lesser ", "2.1")), (4, gnu.format("program", "Affero ", "3"))]
    texts += [(5, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."), (6, "free software general public license conditions and the following copyright notice")]
    rows = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(docs(texts))).collect()}
    assert rows == {1: "gpl-3", 2: "gpl-2", 3: "lgpl", 4: "agpl", 5: "bsd", 6: ""}


def test_license_alignments_equal_brute_force():
    rng = random.Random(6)
    notices = [t.split() for *_, t in licenses.TEMPLATES]
    for skew in ({}, {b"bsd": 90, b"license": 95, b"released": 80, b"under": 99, b"the": 100}):
        index = licenses.Index(licenses.TEMPLATES, licenses.BASE, skew, 100)
        for _ in range(150):
            words = [w for t in rng.choices(notices, k=6) for w in t[rng.choice([0, 0, 0, 1, 3]) :] if rng.random() > 0.03 or rng.random() < 0.1]
            words = [w.encode() if rng.random() > 0.05 else b"x" for w in words]
            assert index.scan(words)[1] == alignments_by_hand(index, words)


def test_license_awkward_rows(awkward):
    rows = licenses.digest(licenses.scan(awkward)).collect()
    assert len(rows) == awkward.count() and {r.labels for r in rows} == {""}
    assert licenses.digest(licenses.scan(awkward.limit(0))).collect() == []


# --- packing -------------------------------------------------------------------------------------


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    return sum(packing.CAPACITY - sum(r.length for r in p) for p in by_sequence.values()) / sum(r.length for r in rows)


def test_packing_keeps_every_token_once(spark):
    rows = QUERIES["op7_packing"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    assert check_packing(rows, texts) < 0.02


def test_packing_awkward_rows(docs):
    texts = {1: None, 2: "", 3: "<|endoftext|> hi", 4: "日本語 🙂 " * 2000, 5: "x" * 100_000, 6: " \n \t "}
    packed = packing.pack(docs(list(texts.items())))
    check_packing(packed.collect(), texts)
    held = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(docs(list(texts.items())), packed).collect()}
    assert sum(held.values()) == sum(r.length for r in packed.collect())
    repeated = packing.pack(docs([(1, "a b"), (1, "a b")])).collect()
    assert len(repeated) == 2
    assert packing.pack(docs([])).collect() == []


def test_ids_equal_the_library(tmp_path):
    """Word by word or as a whole, with an added token or under other settings: as the untouched library gives them."""
    untouched = Tokenizer.from_file(packing.VOCABULARY)
    ids, rng = packing.Ids(packing.VOCABULARY), random.Random(3)
    assert ids.by_word
    assert ids("hello <|endoftext|> there").tolist() == [31373, 220, 50256, 612]
    some = ["'s", "'RE", "  ", "\n\n", "\t", "a", "Ü", "9", "½", "_", "...", "'", " ", "\x00", "\x1c", "\x85", "é", "ж", "日本", "🙂", "<|endoftext|>", "<|end", "word"]
    for _ in range(1500):
        text = "".join(rng.choices(some, k=rng.randint(0, 12)))
        assert ids(text).tolist() == untouched.encode(text, add_special_tokens=False).ids
    settings = json.loads(Path(packing.VOCABULARY).read_text()) | {"normalizer": {"type": "Lowercase"}}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(settings))
    assert not packing.Ids(str(other)).by_word
    assert packing.Ids(str(other))("HELLO there").tolist() == untouched.encode("hello there", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_differencing_is_a_partition_and_balanced(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 512) for _ in range(rng.randint(1, 200))]
    for windows in (1, 2, 7, 30):
        parts = packing.differencing(lengths, windows)
        assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
        assert len(parts) <= windows
    parts = packing.windows_of(lengths)
    sums = [sum(lengths[i] for i in p) for p in parts]
    assert max(sums) <= packing.CAPACITY and len(parts) <= -(-sum(lengths) // packing.CAPACITY) + 1


def test_workers_let_go_of_what_they_keep(monkeypatch):
    import time

    from tidemark.llm import common

    monkeypatch.setattr(common, "KEPT_S", 0.2)
    made = []

    def make():
        made.append(1)
        return object()

    with common.kept("a", make) as first:
        pass
    with common.kept("a", make) as again:
        time.sleep(0.4)  # the timer of the task before must not end a task that runs
        assert again is first and common._kept == {"a": first}
    with common.kept("b", make):
        assert list(common._kept) == ["b"]
    time.sleep(0.6)
    assert not common._kept and len(made) == 2
