"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import cut, map_batches, prefix_hash, range_hash, texts

_U = np.uint64
#: Bytes that end a word: all ASCII but lower-case letters (texts are lower-cased before).
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[0x61:0x7B] = False
NOT_LETTER[0x80:] = False
#: Longer words are summed in logarithms, as products of their piece probabilities may fall below the smallest float.
LINEAR_BYTES = 40
#: Bytes of words whose segmentations are summed side by side.
_BATCH_BYTES = 1 << 17
DEFAULT_PIECES = "/opt/tokenizers/piece_bpe_32k.model"
_CACHE = 200_000


def read_pieces(path: str = DEFAULT_PIECES) -> list[bytes]:
    """Distinct lower-cased letter pieces of a sentencepiece model, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower().strip("▁").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    whole = {p for p in pieces if p and not NOT_LETTER[np.frombuffer(p, np.uint8)].any()}
    return sorted(whole | {bytes([b]) for b in np.flatnonzero(~NOT_LETTER)})


class Lattice:
    """All pieces in a set of words: (end, length, words, pieces) entries by end."""

    def __init__(self, data, starts, ends, vocabulary):
        self.size = size = ends - starts
        self.longest = int(size.max())
        p = prefix_hash(data)
        row = np.repeat(np.arange(len(size)), size)
        end = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1
        at = starts[row] + end
        keys, rows, pieces = [], [], []
        for n in vocabulary.lengths[vocabulary.lengths <= self.longest]:
            ok = np.flatnonzero(end >= n)
            hit, piece = vocabulary.find(range_hash(p, at[ok] - n, at[ok]))
            keys.append(end[ok[hit]] << 16 | n)
            rows.append(row[ok[hit]])
            pieces.append(piece)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, rows, pieces = key[order], np.concatenate(rows)[order], np.concatenate(pieces)[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        self.entries = [(int(key[a]) >> 16, int(key[a]) & 0xFFFF, rows[a:b], pieces[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, i]: sum over the segmentations of the first i bytes; its logarithm if words are long."""
        shape = (len(self.size), self.longest + 1, p.shape[1])
        if self.longest > LINEAR_BYTES:
            alpha, p = np.full(shape, -np.inf), np.log(p)
            alpha[:, 0] = 0
            for i, n, rows, piece in self.entries:
                alpha[rows, i] = np.logaddexp(alpha[rows, i], alpha[rows, i - n] + p[piece])
            return alpha
        alpha = np.zeros(shape)
        alpha[:, 0] = 1
        for i, n, rows, piece in self.entries:
            alpha[rows, i] += alpha[rows, i - n] * p[piece]
        return alpha

    def log_total(self, alpha: np.ndarray) -> np.ndarray:
        last = alpha[np.arange(len(self.size)), self.size]
        return last if self.longest > LINEAR_BYTES else np.log(last)

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations, words counted as counts[word, language]."""
        alpha, total = self.forward(p), None
        out, last = np.zeros_like(p), (np.arange(len(self.size)), self.size)
        if self.longest > LINEAR_BYTES:
            total, log_p = alpha[last], np.log(p)
            beta = np.full_like(alpha, -np.inf)
            beta[last] = 0
            for i, n, rows, piece in reversed(self.entries):
                beta[rows, i - n] = np.logaddexp(beta[rows, i - n], beta[rows, i] + log_p[piece])
            for i, n, rows, piece in self.entries:
                np.add.at(out, piece, np.exp(alpha[rows, i - n] + log_p[piece] + beta[rows, i] - total[rows]) * counts[rows])
            return out
        beta = np.zeros_like(alpha)
        beta[last] = 1
        for i, n, rows, piece in reversed(self.entries):
            beta[rows, i - n] += beta[rows, i] * p[piece]
        scale = counts / alpha[last]
        for i, n, rows, piece in self.entries:
            np.add.at(out, piece, alpha[rows, i - n] * p[piece] * beta[rows, i] * scale[rows])
        return out


def _word_groups(size: np.ndarray):
    """Indexes of words in groups of like length, of about _BATCH_BYTES bytes or one word."""
    order = np.argsort(size, kind="stable")
    short = int(np.searchsorted(size[order], LINEAR_BYTES, "right"))
    for part in (order[:short], order[short:]):
        i = 0
        while i < len(part):
            j = i + max(1, int(np.searchsorted(np.arange(1, len(part) - i + 1) * size[part[i:]], _BATCH_BYTES, "right")))
            yield part[i:j]
            i = j


class Vocabulary:
    def __init__(self, pieces: list[bytes]):
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        hashes = range_hash(prefix_hash(flat), ends - [len(p) for p in pieces], ends)
        order = np.argsort(hashes)
        self.hashes, self.index = hashes[order], order
        self.size, self.lengths = len(pieces), np.unique([len(p) for p in pieces])
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(hashes >> _U(46)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = np.flatnonzero(self.seen[(hashes >> _U(46)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[hit]), self.size - 1)
        same = self.hashes[at] == hashes[hit]
        return hit[same], self.index[at[same]]


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[bytes]
    p: np.ndarray  # (pieces, languages)
    prior: np.ndarray


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


def _count_words(batches):
    """(lang, word, n) of each batch."""
    for batch in batches:
        langs, words, counts = [], [], []
        names = batch.column(1).to_pylist()
        tally: dict[tuple[str, bytes], int] = {}
        for piece in texts(_lowered(batch.column(0))):
            starts, ends, first = piece.words(NOT_LETTER)
            raw = piece.data.tobytes()
            for r in range(piece.n):
                lang = names[piece.first + r]
                for a, b in zip(starts[first[r] : first[r + 1]].tolist(), ends[first[r] : first[r + 1]].tolist()):
                    key = (lang, raw[a:b])
                    tally[key] = tally.get(key, 0) + 1
        for (lang, word), n in tally.items():
            langs.append(lang)
            words.append(word)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "n"])


def _expect(shared):
    def run(batches):
        pieces, p, languages = shared.value
        vocabulary, total = Vocabulary(pieces), np.zeros_like(p)
        at = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            words = batch.column(1).to_pylist()
            flat = np.frombuffer(b"".join(words), np.uint8)
            size = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(size)
            counts = np.zeros((len(words), len(languages)))
            counts[np.arange(len(words)), [at[x] for x in batch.column(0).to_pylist()]] = batch.column(2).to_numpy()
            for group in _word_groups(size):
                total += Lattice(flat, (ends - size)[group], ends[group], vocabulary).expected(p, counts[group])
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "uses"])

    return run


def fit_language_model(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    order_col: str = "doc_id",
    rows_per_language: int = 4000,
    rounds: int = 3,
    pieces: list[bytes] | None = None,
) -> LanguageModel:
    """Piece probabilities of each language, by expectation-maximisation over all segmentations.

    Fitted on the whole texts of a sample of about rows_per_language labelled rows of each
    language, chosen by hash of order_col; languages with fewer rows give all. Tasks count
    words and expected pieces; the driver gets one number for each piece and language. Rows with
    null text or language take no part.
    """
    spark = docs.sparkSession
    pieces = pieces or read_pieces()
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().toLocalIterator()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)), np.zeros(0))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, rows_per_language / sizes[k])))])
    u = F.pmod(F.xxhash64(order_col, F.lit(23)), F.lit(1 << 30)) / (1 << 30)
    sample = rows.where(u < F.element_at(share, F.col(lang_col))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    words = cut(map_batches(sample, _count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, p, languages))
        uses = np.full(p.shape, 0.1)
        for r in map_batches(words, _expect(shared), "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toLocalIterator():
            uses[r.piece, r.lang] += r.uses
        p = np.maximum(uses / uses.sum(axis=0), 1e-7)
        shared.destroy()
    prior = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, pieces, p, np.log(prior / prior.sum()))


def _score(shared, kept_at: int):
    """The text is the second column; columns from kept_at on go along."""

    def run(batches):
        model: LanguageModel = shared.value
        vocabulary, n_langs = Vocabulary(model.pieces), len(model.languages)
        known, known_scores = np.zeros(0, _U), np.zeros((0, n_langs))
        for batch in batches:
            preds, scores = [], []
            for piece in texts(_lowered(batch.column(1))):
                starts, ends, first = piece.words(NOT_LETTER)
                p = prefix_hash(piece.data)
                words, one, back = np.unique(range_hash(p, starts, ends), return_index=True, return_inverse=True)
                value = np.empty((len(words), n_langs))
                at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
                old = known[at] == words if len(known) else np.zeros(len(words), bool)
                value[old] = known_scores[at[old]]
                new = np.flatnonzero(~old)
                for group in _word_groups((ends - starts)[one[new]]):
                    part = one[new[group]]
                    lattice = Lattice(piece.data, starts[part], ends[part], vocabulary)
                    value[new[group]] = lattice.log_total(lattice.forward(model.p))
                if len(known) < _CACHE and len(new):
                    known = np.concatenate([known, words[new]])
                    known_scores = np.concatenate([known_scores, value[new]])
                    order = np.argsort(known)
                    known, known_scores = known[order], known_scores[order]
                sums = np.zeros((piece.n, n_langs))
                np.add.at(sums, np.repeat(np.arange(piece.n), np.diff(first)), value[back.ravel()])
                sums += model.prior
                lower = piece.data
                for r in range(piece.n):
                    own = lower[piece.offsets[r] : piece.offsets[r + 1]]
                    letter = n_langs and first[r + 1] > first[r] and (((own >= 0x61) & (own < 0x7B)).any() or any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace")))
                    if not letter:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    e = np.exp(sums[r] - sums[r].max())
                    preds.append(model.languages[int(e.argmax())])
                    scores.append(float(e.max() / e.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), *batch.columns[kept_at:]], ["id", "lang_pred", "score", *batch.schema.names[kept_at:]])

    return run


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, and the columns ``keep``) for every row; score is the posterior of lang_pred.

    The text is lower-cased; its words are runs of ASCII letters and non-ASCII characters. A word's
    probability in a language is the sum, over all ways to cut it into pieces, of the product of
    piece probabilities (forward algorithm over the whole word, of any length); a text's is the product
    over its words and the language's share of the labelled rows. The model is broadcast: one number
    for each piece and language. Distinct words are scored once for each slice of a task.

    Null and empty texts and texts without a letter, and all texts if the model has no languages: 'und', score 0.
    Ties go to the first language by name. Repeated rows each get a row, null ids stay, other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k_{c}") for c in keep or [] if c != text_col])
    kept_at = 1 if text_col in (keep or []) else 2
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[kept_at:])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = map_batches(rows, _score(shared, kept_at), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double{kept}")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", *[F.col("text" if c == text_col else f"k_{c}").alias(c) for c in keep or []])
