import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanforge.llm import bpe, packing, token_files
from spanforge.llm.common import table
from spanforge.llm.tokens import Encoder, public

from .helpers import documents, prose

ODD = ["<|endoftext|>a <|startoftext|>", "\x1cx\x85y\xa0z", "é É ΑΣ İ", "it's we'll 12 345 ...!!", "日本 🙂 ‍", "a" * 5000, " \n\n  x  \t", "=" * 300]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, keeps):
    lib, own = Tokenizer.from_file(public(name)), Encoder(public(name), keeps)
    for text in [*ODD, *(t or "" for t in prose()), "word\n " * 400_000]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_transducer_equals_library():
    lib, own = Tokenizer.from_file(public("word_bpe_49k.json")), bpe.WordBPE(public("word_bpe_49k.json"))
    for text in [*ODD, *(t or "" for t in prose()), "abcz" * 30_000]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == ids
        decoder = bpe.Decoder(own.names, own.plain)
        said = "".join(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + decoder.end()
        assert said == lib.decode(ids, skip_special_tokens=False)


def test_transducer_holds_little():
    own = bpe.WordBPE(public("word_bpe_49k.json")).transducer
    most, n = 0, 0
    for k in range(300):
        n += len(own.feed("thequickbrownfoxjumps" * 10))
        most = max(most, len(own.text))
    assert most < 10 * own.m.lookahead and n


def test_byte_decoder_waits_for_whole_characters():
    names = {i: c for i, c in enumerate(bpe.byte_letters())}
    d = bpe.Decoder(names, False)
    assert [d.feed([b]) for b in "é🙂".encode()] == ["", "é", "", "", "", "🙂"]
    assert d.feed([0xC3]) == "" and d.end() == "�"


def test_op10_rows(spark):
    texts = prose(3, 20)
    lib = Tokenizer.from_file(public("word_bpe_49k.json"))
    docs = documents(spark, [*texts, (None, "no id"), (3, "twice")])
    got = sorted((r["doc_id"] is None, r["doc_id"], *r[1:]) for r in bpe.encode_decode(docs, public("word_bpe_49k.json")).collect() if r["doc_id"] is not None)
    want = []
    for i, t in [*enumerate(texts), (3, "twice")]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((False, i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


def test_plan_is_gapless_best_fit():
    for hist in ({}, {7: 1}, {10: 3, 3: 7, 1: 20}, {10: 1, 6: 5, 5: 4, 4: 9, 1: 1}, {k: k % 4 for k in range(1, 11)}):
        bins, seen = defaultdict(list), defaultdict(set)
        for length, rank, n, each, first, offset in packing.plan(hist, 10):
            for i in range(n * each):
                assert rank + i not in seen[length]
                seen[length].add(rank + i)
                bins[first + i // each].append((offset + i % each * length, length))
        assert {k: len(v) for k, v in seen.items()} == {k: v for k, v in hist.items() if v}
        assert all(set(v) == set(range(len(v))) for v in seen.values())
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 10
        # one piece after another into the fullest bin with room
        rooms = []
        for length in sorted((k for k, v in hist.items() for _ in range(v)), reverse=True):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(10 - length)
        assert len(bins) == len(rooms)


def check_packed(rows, texts, capacity, path):
    lib = Tokenizer.from_file(path)
    want = {}
    for i, t in texts.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(v[1] for v in want.values())
    assert len(bins) <= total / capacity * 11 / 9 + 1


def test_op5_rows(spark):
    texts = prose(5, 40)
    path = public("word_bpe_49k.json")
    check_packed(packing.best_fit_packing(documents(spark, texts), path, 64).collect(), dict(enumerate(texts)), 64, path)
    assert packing.best_fit_packing(documents(spark, []), path).collect() == []
    assert packing.best_fit_packing(documents(spark, [(1, "a"), (1, "a"), (None, None)]), path).count() == 3


def test_op8_rows(spark, sf_dir):
    texts = prose(6, 40)
    path = public("byte_bpe_50k.json")
    lib, at, want = Tokenizer.from_file(path), 0, []
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.token_files(documents(spark, texts).repartition(3), path, sequence=16)
    assert sorted(map(tuple, got.collect())) == want
    assert token_files.token_files(documents(spark, []), path).collect() == []


def test_file_random_access(tmp_path):
    ids = np.arange(1000) % 777
    w = token_files.Writer(f"{tmp_path}/x/a.arrow", 8, True)
    for part in np.array_split(ids, 7):
        w.add(part)
    w.close()
    r = token_files.Reader(f"file://{tmp_path}/x/a.arrow")
    assert r.ids(123, 700).tolist() == ids[123:823].tolist()
    got, mask = r.sequence(124)
    assert got.tolist() == ids[992:].tolist() and mask.all()
    assert r.file.schema.field("ids").type.list_size == 8
    w = token_files.Writer(f"{tmp_path}/b.arrow", 8, False)
    w.add(np.arange(3))
    w.close()
    assert token_files.Reader(f"{tmp_path}/b.arrow").sequence(0)[1].tolist() == [True] * 3 + [False] * 5


def test_letters_of_the_library_edition(spark):
    """Letters and cases that Python's own tables may lack, marks, Hangul and special tokens."""
    lib, own = Tokenizer.from_file(public("word_bpe_49k.json")), bpe.WordBPE(public("word_bpe_49k.json"))
    for first, last in ((0x1C80, 0x1C90), (0xA7C0, 0xA7F8), (0x105C0, 0x105F8), (0x10D40, 0x10D90), (0x300, 0x340), (0x1100, 0x1110), (0x1F000, 0x1F010), (0x2000, 0x2010)):
        for c in map(chr, range(first, last)):
            text = f"a{c}b{c}{c} {c} <|endoftext|>{c}Σ"
            assert own.ids(text) == lib.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_long_texts_leave_in_parts(spark):
    """A long text that is not plain: ids come in lists far shorter than the text, and the transducer keeps no more than its lookahead asks for."""
    own = bpe.WordBPE(public("word_bpe_49k.json"))
    text = "中文 word " * 300_000 + "é́x" * 20_000
    most = held = n = 0
    for ids in own.lists(text):
        most, held, n = max(most, len(ids)), max(held, len(own.transducer.text)), n + len(ids)
    assert n > 1_000_000 and most <= bpe.STEP + 4 * own.merges.lookahead and held <= 8 * own.merges.lookahead


def test_token_files_of_repeated_and_missing_ids(spark):
    lib = Tokenizer.from_file(public("byte_bpe_50k.json"))
    rows = [(None, "x y"), (None, None), (4, "a b c"), (4, "d"), (4, "d"), (9, "")]
    got = token_files.token_files(documents(spark, rows), public("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 4, 4, 4, 9]
    sizes = [r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [sum(sizes[:i]) for i in range(6)]
    assert sorted(sizes) == sorted(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_heads_of_words_are_kept_and_change_nothing(monkeypatch):
    """Words that share their heads, with heads dropped now and then, and words that a stream feeds in pieces."""
    monkeypatch.setattr(bpe, "HEADS_KEPT", 9)
    lib, own = Tokenizer.from_file(public("word_bpe_49k.json")), bpe.WordBPE(public("word_bpe_49k.json"))
    word = "internationalisierung" * 20
    words = [word[i:j] + end for i in range(4) for j in range(i + 1, 26) for end in ("", "s", "é", "ing")] + [word, word[:9], word]
    for w in words:
        assert own.part(w) == lib.encode(w, add_special_tokens=False).ids
    assert 0 < len(own.transducer.heads) <= 9 and own.transducer.text == []
    t = own.transducer
    got = [x for c in word[:40] for x in t.feed(c)] + t.feed([word[40] + own.merges.suffix]) + t.end()
    assert [own.vocab[x] for x in got] == lib.encode(word[:41], add_special_tokens=False).ids


def test_words_of_letters_are_one_piece():
    """A word of ASCII letters goes to the merges without a split; all others are split as the library does."""
    from spanforge.llm.tokens import Encoder

    for name, keeps_space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        lib, own = Tokenizer.from_file(public(name)), Encoder(public(name), keeps_space)
        split, own.pieces = own.pieces, lambda x: split(x) if not x.strip().isalpha() or not x.isascii() or x[:1].isspace() and x[0] != " " or x[:2] == "  " else 1 / 0
        for text in ("The quick brown Foxes don't jump", " a  b\n c\td é È1x x1 it's 'tis", "x", " ", "", "\nabc", "  abc", "word, word. (word)", "naïve über Straße"):
            for _ in range(2):
                got = np.frombuffer(own.ids(text), "<u4").tolist()
                assert got == lib.encode(text, add_special_tokens=False).ids, text
