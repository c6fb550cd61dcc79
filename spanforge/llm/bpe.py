"""BPE encoding and decoding (10): a streaming transducer with the merge list's lookahead, and an incremental decoder."""

from __future__ import annotations

import codecs
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import no_collection, no_text_is_empty, null_id
from .tokens import BLOCK, PLAIN, UNSPACED, blocks, byte_letters

#: Words kept in each of two generations, and parts kept.
CACHED = 300_000
#: Symbols fed at once.
STEP = 1 << 12
#: Lengths of the words' heads whose last tokens are kept, and the number of heads kept.
HEADS, HEADS_KEPT = (8, 6, 4), 300_000

#: The letters in order of their bytes, and back.
LETTERS = byte_letters()
BYTES = {c: b for b, c in enumerate(LETTERS)}


class Merges:
    """A merge list and its vocabulary; symbols are byte letters, of which the last of a word carries the word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.suffix, self.vocab = suffix, vocab
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in reversed(list(enumerate(merges)))}
        made = {a + b for a, b in self.rank} | {t for t in vocab if len(self.symbols(t)) == 1}
        #: Tokens that a merge makes or that are one symbol; the others never come out.
        self.tokens = made & vocab.keys()
        #: Symbols in the longest token: a token that ends later than this after a place can't begin before it.
        self.lookahead = max((len(self.symbols(t)) for t in self.tokens), default=1)
        self.parts = {a + b: (a, b) for a, b in sorted(self.rank, key=self.rank.get, reverse=True)}
        self.made = {t: self.rank[x] for t, x in self.parts.items()}
        if len(self.parts) != len(self.rank):
            raise ValueError("two merges make the same token")
        #: For each token what is known of holds(left, token), by left.
        self.pairs: dict[str, dict[str, bool]] = {t: {} for t in self.tokens}
        self.kept = 0
        self.ends: dict[str, int] = {}
        for t in self.tokens:
            s = self.symbols(t)
            self.ends[s[-1]] = max(self.ends.get(s[-1], 1), len(s))

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            letters = list(token[: -len(self.suffix)])
            return [*letters[:-1], letters[-1] + self.suffix]
        return list(token)

    def holds(self, left: str, right: str) -> bool:
        """Whether the merges leave left and right side by side, both whole; left is '' at a word's begin.

        The merges are undone in reverse, always the later one of the two tokens
        at the border (the right one of two equal ones, as the left is merged
        first). Had the two tokens then at the border a merge that comes before
        those undone, it would have gone first.
        """
        known = self.pairs[right].get(left)
        if known is None:
            known = self.undone(left, right)
            if self.kept > 4 * CACHED:
                self.kept = 0
                for lefts in self.pairs.values():
                    lefts.clear()
            self.kept += 1
            self.pairs[right][left] = known
        return known

    def undone(self, left: str, right: str) -> bool:
        if not left:
            return True
        limit = 1 << 60
        while True:
            if self.rank.get((left, right), 1 << 60) < limit:
                return False
            a, b = self.made.get(left, -1), self.made.get(right, -1)
            if a > b:
                limit, left = a, self.parts[left][1]
            elif b >= 0:
                limit, right = b + 1, self.parts[right][0]
            else:
                return True


class Transducer:
    """feed(symbols) gives the tokens that no further symbol can change; end() the rest of the word.

    A list of tokens is the merges' result just where each pair of neighbours
    holds. So each prefix of a word has one last token: the one that ends there
    and holds beside the last token of the prefix before it. Whatever follows,
    the result goes on from one of the prefixes of the last `lookahead` symbols,
    and what these have in common is stable and is emitted. Only what lies
    behind that point is kept.
    """

    def __init__(self, merges: Merges):
        self.m = merges
        #: The last tokens of a word's first prefixes, by its head; they do not depend on what follows.
        self.heads: dict[str, tuple] = {}
        self.start()

    def start(self) -> None:
        self.text: list[str] = []  # symbols behind the stable point
        self.last = [("", 0)]  # of each prefix from the stable point on: its last token and that token's length
        self.new = 0
        self.begun = False

    def feed(self, symbols) -> list[str]:
        out, m, head = [], self.m, 0
        pairs, ends, text, last = m.pairs, m.ends, self.text, self.last
        learns = not self.begun and isinstance(symbols, str)
        self.begun = True
        if learns:
            for n in HEADS:
                found = self.heads.get(symbols[:n]) if n <= len(symbols) else None
                if found is not None:
                    head = self.new = n
                    text += symbols[:n]
                    last += found
                    break
        i = len(text)
        for x in symbols[head:]:
            text.append(x)
            i += 1
            token = ""
            for n in range(1, min(i, ends.get(x, 1)) + 1):
                token = text[i - n] + token
                lefts = pairs.get(token)
                if lefts is not None:
                    left = last[i - n][0]
                    ok = lefts.get(left)
                    if m.holds(left, token) if ok is None else ok:
                        last.append((token, n))
                        break
            else:
                raise ValueError(f"no token ends at {x!r}")
            self.new += 1
            if self.new >= 4 * m.lookahead:
                learns = False
                out += self.settle()
                text, last, i = self.text, self.last, len(self.text)
        if learns:
            for n in HEADS:
                if head < n <= i:
                    if len(self.heads) >= HEADS_KEPT:
                        self.heads.clear()
                    self.heads[symbols[:n]] = tuple(last[1 : n + 1])
        return out

    def path(self, i: int) -> list[str]:
        out = []
        while i:
            token, n = self.last[i]
            out.append(token)
            i -= n
        return out[::-1]

    def settle(self) -> list[str]:
        self.new = 0
        heads = {*range(max(0, len(self.text) - self.m.lookahead + 1), len(self.text) + 1)}
        while len(heads) > 1:
            i = max(heads)
            heads.remove(i)
            heads.add(i - self.last[i][1])
        at = heads.pop()
        out = self.path(at)
        if at:
            del self.text[:at]
            self.last = [(self.last[at][0], 0), *self.last[at + 1 :]]
        return out

    def end(self) -> list[str]:
        out = self.path(len(self.text))
        self.start()
        return out


class Decoder:
    """feed(ids) gives the text known so far, end() the rest.

    Byte-level vocabularies: letters become bytes, and a UTF-8 state machine
    turns these into text as soon as a character is whole. Without a decoder
    (plain), tokens are joined by blanks as they stand.
    """

    def __init__(self, names: dict[int, str], plain: bool):
        self.names, self.plain = names, plain
        self.state, self.begun = None if plain else codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids) -> str:
        found = [self.names[i] for i in ids if i in self.names]
        if not self.plain:
            return self.state.decode(b"".join(bytes([BYTES[c]]) if c in BYTES else c.encode() for t in found for c in t))
        out = " " * (self.begun and bool(found)) + " ".join(found)
        self.begun |= bool(found)
        return out

    def end(self) -> str:
        return "" if self.plain else self.state.decode(b"", True)


class WordBPE:
    """Texts to ids and back under a word-end BPE file: NFC, one blank for white space, lower case, a split, merges per part.

    What is held beside a text is about a block of it, or its longest stretch
    without white space; ids and decoded text leave as soon as they are stable.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)  # its normalizer and split only; merging and decoding are done here
        model = spec["model"]
        self.vocab = model["vocab"]
        self.merges = Merges(self.vocab, model["merges"], model["end_of_word_suffix"] or "")
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.plain = spec.get("decoder") is None
        self.split = UNSPACED
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda t: [t]
        self.transducer = Transducer(self.merges)
        self.cache: dict[str, tuple[int, bytes, bytes]] = {}
        self.old: dict[str, tuple[int, bytes, bytes]] = {}
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def stream(self, symbols: str):
        """Lists of the ids of one word, given as byte letters; a list comes out as soon as it is stable."""
        for k in range(0, len(symbols) - 1, STEP):
            yield [self.vocab[t] for t in self.transducer.feed(symbols[k : min(k + STEP, len(symbols) - 1)])]
        yield [self.vocab[t] for t in [*self.transducer.feed([symbols[-1] + self.merges.suffix]), *self.transducer.end()]]

    def part(self, part: str) -> list[int]:
        """Ids of one part of a plain text's split."""
        symbols = part if part.isascii() else "".join([LETTERS[b] for b in part.encode("utf-8")])
        if len(symbols) > STEP:
            return [i for ids in self.stream(symbols) for i in ids]
        t = self.transducer
        return [self.vocab[x] for x in [*t.feed(symbols[:-1]), *t.feed([symbols[-1] + self.merges.suffix]), *t.end()]]

    def ids(self, text: str) -> list[int]:
        return [i for ids in self.lists(text) for i in ids]

    def lists(self, text: str):
        """Lists of the ids of any text, one after another. The library's own normalizer and split, which know its edition of Unicode, cut the words."""
        for stretch in blocks(text, space=r"[\t-\r ]"):
            for part in self.specials(stretch):
                if part in self.added:
                    yield [self.added[part]]
                elif part:
                    for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                        yield from self.stream(word)

    def coded(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids in decimal, and their tokens decoded."""
        decoder = Decoder(self.names, self.plain)
        return len(ids), " ".join(map(str, ids)).encode(), (decoder.feed(ids) + decoder.end()).encode()

    def of(self, word: str) -> tuple[int, bytes, bytes]:
        """coded() of a word of a plain text, from its parts, which are kept too; a part's tokens decode the same wherever it stands."""
        found = []
        for part in (word.lower(),) if word.isascii() and word.isalpha() else self.split(word.lower()):
            x = self.known.get(part)
            if x is None:
                x = self.coded(self.part(part))
                if len(part) <= 64:
                    if len(self.known) > CACHED:
                        self.known.clear()
                    self.known[part] = x
            found.append(x)
        if len(found) == 1:
            return found[0]
        return sum([x[0] for x in found]), b" ".join([x[1] for x in found]), b" ".join([x[2] for x in found])

    def words(self, text: str):
        """The same for each word of a plain text."""
        words = text.split()
        found = list(map(self.cache.get, words))
        if None in found:
            if len(self.cache) > CACHED:
                self.old, self.cache = self.cache, {}
            for i in [i for i, x in enumerate(found) if x is None]:
                w = words[i]
                found[i] = self.cache.get(w) or self.old.get(w) or self.of(w)
                if len(w) <= 64:
                    self.cache[w] = found[i]
        return found

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by blanks, and of the decoded text."""
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        if "<|" in text or not PLAIN.fullmatch(text) or not self.plain:
            decoder = Decoder(self.names, self.plain)
            for part in self.lists(text):
                if part:
                    ids.update(b" " * bool(n) + " ".join(map(str, part)).encode())
                    decoded.update(decoder.feed(part).encode())
                    n += len(part)
            decoded.update(decoder.end().encode())
            return n, ids.hexdigest(), decoded.hexdigest()
        found = map(self.words, blocks(text) if len(text) > BLOCK else [text])
        for part in found:
            part = [x for x in part if x[0]]
            if part:
                glue = b" " * bool(n)
                ids.update(glue + b" ".join([x[1] for x in part]))
                decoded.update(glue + b" ".join([x[2] for x in part]))
                n += sum([x[0] for x in part])
        return n, ids.hexdigest(), decoded.hexdigest()


_codes: dict[str, WordBPE] = {}


def code(path: str) -> WordBPE:
    """One per Python worker and file."""
    if path not in _codes:
        _codes[path] = WordBPE(path)
    return _codes[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs, from their whole texts.

    A null or empty text has no ids and decodes to the empty text. Rows are
    worked on one by one, so that repeated ids do no harm.
    """

    def run(batches):
        c = code(path)
        for batch in batches:
            with no_collection():
                got = [c.digests(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = no_text_is_empty(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(null_id(), "n_tokens", "ids_sha256", "decoded_sha256")
