"""Language identification by cross-parsing entropy (operator 10).

For each language, a suffix automaton of a bounded sample of its labelled text answers how long the text
at hand can be read on as something that occurs in the sample. Cutting a text greedily into such longest
matches gives phrases; the fewer phrases, the nearer the language. Counts are normalised to
``phrases * log2(sample length) / text length``, the cross-parsing estimate of the entropy in bits per
character, and the least wins (ties go to the language that comes first).

The sample holds ``chars_per_language`` characters at most for each language, of documents in seeded
order, at most ``chars_per_document`` from each: bounded, however large the corpus, so it can go through the
driver and be broadcast. Everything else covers whole texts. Automata are built once per Python worker.

Texts are parsed many at a time: automata are dense tables of next states, and one NumPy gather moves all
texts of a batch, in all languages, on by one character. Every batch is bounded by characters, whatever its number
of rows. Long texts are cut into stretches that go side by side, each read as if a phrase began with it. Then what its
forerunner really left off in is read beside that, until both are in one state: from there on they agree. Mostly that
takes a few phrases; where it takes the whole stretch (as in periodic texts), the next stretch is read again. So the counts are
those of one reading from the first character to the last.

Characters are lower-cased; all that are no letters count as one kind, and a run of them as one.

Defined cases: ``und`` with score 0 where the text is null or has no letter, or where nothing could be
learned; repeated rows are judged one by one; an empty table gives an empty result. A row without an id is judged like
any other, its ``held_out`` is null, and nothing is learned from it. A very long text is read whole, in stretches; its symbols
take two bytes each. Columns beside id, text and language never matter, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialize, row_key, scan_of, seeded_order, steps, table, unit_of, without

UNDETERMINED = "und"
SCHEMA = "lang_pred string, score double, bits double"


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def training_sample(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    chars_per_language: int = 16_384,
    chars_per_document: int = 256,
    seed: int = 3,
) -> dict[str, str]:
    """Bounded text of each language, from rows of ``docs`` with text and language."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    wanted = 4 * chars_per_language // chars_per_document
    if not counts:
        return {}
    # Thin each language to about twice the rows wanted before anything is sorted.
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * wanted / n))).otherwise(share)
    order = seeded_order(seed, F.col("doc_id"))
    picked = (
        rows.withColumn("h", order)
        .filter(unit_of(F.col("h")) < share)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("h", F.substring("text", 1, chars_per_document).alias("piece")))).alias("pieces"))
        .collect()
    )
    sample = {}
    for row in sorted(picked, key=lambda r: r["lang"]):
        if text := " ".join(p["piece"] for p in row["pieces"])[:chars_per_language]:
            sample[row["lang"]] = text
    return sample


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one 32."""
    pieces = list(_symbols(text))
    return np.concatenate(pieces) if pieces else np.empty(0, np.uint32)


def _symbols(text: str, chars: int = 1_000_000) -> Iterator[np.ndarray]:
    """The symbols of ``text``, from ``chars`` of its characters at a time. The whole is lower-cased first: that depends on what stands around."""
    lower, before = text.lower(), 0
    for at in range(0, len(lower), chars):
        codes = np.frombuffer(lower[at : at + chars].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(_letters(int(codes.max()) + 1)[codes], codes, np.uint32(32))
        keep = (codes != 32) | (np.append(np.uint32(before), codes[:-1]) != 32)
        before = int(codes[-1])
        yield codes[keep]


@functools.lru_cache(maxsize=4)
def _letters_upto(n: int) -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)


def _letters(n: int) -> np.ndarray:
    return _letters_upto(0x3000 if n <= 0x3000 else 0x110000)


def suffix_automaton(sequence: list[int], width: int) -> np.ndarray:
    """Next states of the automaton of all substrings, [states, width], -1 where there is none; 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sequence:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.full((len(moves), width), -1, np.int32)
    for state, to in enumerate(moves):
        for c, nxt in to.items():
            out[state, c] = nxt
    return out


class Parser:
    """All languages' automata in one table; their start states are ``starts``."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        texts = [symbols(sample[x]) for x in self.langs]
        alphabet = np.unique(np.concatenate(texts))
        self.width = len(alphabet) + 1  # the last symbol is one that no sample has
        self.lut = np.full(max(int(alphabet.max()) + 2, 0x3000), self.width - 1, np.uint16)
        self.lut[alphabet] = np.arange(len(alphabet))
        parts, self.starts, at = [], [], 0
        for t in texts:
            moves = suffix_automaton(self.lut[t].tolist(), self.width)
            # Where a match ends, a phrase ends: the same character begins the next one, from the start. High bits hold
            # the phrases that have ended; a character that no sample has is a phrase of its own.
            known = moves[0] >= 0
            restart = np.where(known, moves[0] + at + _PHRASE, at + 2 * _PHRASE)
            moves = np.where(moves >= 0, moves + at, restart[None, :])
            moves[0, ~known] -= _PHRASE
            parts.append(moves.astype(np.int32))
            self.starts.append(at)
            at += len(moves)
        if at >= _PHRASE:
            raise ValueError(f"the samples need {at} states; {_PHRASE} fit")
        self.table = np.concatenate(parts).ravel()
        self.scale = np.array([math.log2(max(len(t), 2)) for t in texts])

    def encode(self, text: str) -> np.ndarray:
        pieces = [self.lut[np.minimum(codes, len(self.lut) - 1)] for codes in _symbols(text)]
        return np.concatenate(pieces) if pieces else np.empty(0, np.uint16)

    def phrases(self, texts: list[np.ndarray], stretch: int = 4_096) -> np.ndarray:
        """Number of phrases of each text in each language, [texts, languages]."""
        if not texts:
            return np.zeros((0, len(self.langs)), np.int64)
        flat = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        pieces = np.maximum(-(-sizes // stretch), 1)
        owner, first = np.repeat(np.arange(len(texts)), pieces), np.cumsum(pieces) - pieces
        begin = (np.cumsum(sizes) - sizes)[owner] + stretch * (np.arange(len(owner)) - first[owner])
        lengths = np.minimum(np.cumsum(sizes)[owner] - begin, stretch)
        start = np.repeat(np.array(self.starts, np.int64)[:, None], len(owner), axis=1)
        count, left = self._read(flat, begin, lengths, start)
        follows = np.append(False, owner[1:] == owner[:-1])
        assumed = start.copy()
        while True:
            # What a stretch was entered in, now that its forerunner has been read: the first ones are right from the beginning.
            entered = np.where(follows, np.roll(left, 1, axis=1), start)
            lang, which = np.nonzero(entered != assumed)
            if not len(which):
                break
            more, ended = self._correct(flat, begin[which], lengths[which], assumed[lang, which], entered[lang, which], left[lang, which])
            count[lang, which] += more
            left[lang, which] = ended
            assumed = entered
        count[:, first + pieces - 1] += left[:, first + pieces - 1] != start[:, first]  # what was being read when the text ended
        return np.add.reduceat(count, first, axis=1).T

    def _read(self, flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each stretch, and the state at its end, [languages, stretches]."""
        order = np.argsort(-lengths, kind="stable")
        begin, lengths, state = begin[order], lengths[order], state[:, order]
        count = np.zeros(state.shape, np.int64)
        alive = len(order)
        for t in range(int(lengths[0])):
            while lengths[alive - 1] <= t:
                alive -= 1
            nxt = self.table[state[:, :alive] * self.width + flat[begin[:alive] + t]]
            count[:, :alive] += nxt >> _BITS
            state[:, :alive] = nxt & (_PHRASE - 1)
        back = np.argsort(order)
        return count[:, back], state[:, back]

    def _correct(self, flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray, old: np.ndarray, new: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many more phrases end in each stretch when it is entered in ``new`` instead of ``old``, which leaves it in ``left``; and what it is left in."""
        more, left, alive = np.zeros(len(begin), np.int64), left.copy(), np.arange(len(begin))
        t = 0
        while len(alive):
            symbol = flat[begin[alive] + t]
            a, b = self.table[old * self.width + symbol], self.table[new * self.width + symbol]
            more[alive] += (b >> _BITS) - (a >> _BITS)
            old, new = (a & (_PHRASE - 1)).astype(np.int64), (b & (_PHRASE - 1)).astype(np.int64)
            t += 1
            over = lengths[alive] <= t
            left[alive[over]] = new[over]
            on = (old != new) & ~over
            alive, old, new = alive[on], old[on], new[on]
        return more, left


_BITS = 29
_PHRASE = 1 << _BITS


@functools.lru_cache(maxsize=1)
def _parser(sample: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(sample))


def _verdicts(parser: Parser | None, texts: list[str | None]) -> tuple[list, list, list]:
    lang, score, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
    spoken = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if parser else []
    coded = [parser.encode(texts[i]) for i in spoken]
    for i, seq, row in zip(spoken, coded, parser.phrases(coded) if spoken else (), strict=True):
        entropy = row * parser.scale / max(len(seq), 1)
        best = int(entropy.argmin())
        lang[i], bits[i] = parser.langs[best], float(entropy[best])
        near = 2.0 ** (-8.0 * (entropy - entropy[best]) / entropy[best])
        score[i] = float(1.0 / near.sum())
    return lang, score, bits


def _predict(sample: tuple, chars_per_batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sample) if sample else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)) if len(texts) else np.empty(0)
            cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(chars_per_batch, sizes.sum() + chars_per_batch, chars_per_batch)) + 1)
            last = 0
            for cut in [*cuts[cuts < len(texts)].tolist(), len(texts)]:
                part = batch.slice(last, cut - last)
                last = cut
                if len(part):
                    lang, score, bits = _verdicts(parser, part.columns[-1].to_pylist())
                    kept, names = part.columns[:-1], part.schema.names[:-1]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], [*names, "lang_pred", "score", "bits"]
                    )
        pa.default_memory_pool().release_unused()

    return run


def identify(rows: DataFrame, sample: dict[str, str], text_col: str = "text", carry: list[str] | None = None, chars_per_batch: int = 4_000_000) -> DataFrame:
    """The columns ``carry`` (default: ``doc_id``) of ``rows``, and ``lang_pred, score, bits``."""
    carry = carry or ["doc_id"]
    narrow = rows.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(_predict(tuple(sorted(sample.items())), chars_per_batch), f"{fields}, {SCHEMA}")


def op10_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = training_sample(docs.filter(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, sample, carry=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose language can be told, with the columns they came with; ``und`` goes.

    Only the keys of what goes are written and joined; documents themselves never come back from Python.
    """
    sample = training_sample(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    scan = scan_of(docs)
    with steps(docs.sparkSession):
        judged = identify(scan.select(*row_key(scan), F.col(text_col).alias("text")), sample, carry=["file", "at"])
        gone = materialize(judged.filter(F.col("lang_pred") == UNDETERMINED).select("file", "at"), "und", lasting=True)
    return without(scan, gone)


QUERIES = {"op10_cross_parsing_language": op10_cross_parsing_language}
#: Automata have no form in SQL; tests hold phrases against a direct search for the longest match, and accuracy on held-out rows.
ORACLES: dict[str, str] = {}
