"""Quality rules: line labels from a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.functions.shared import saved
from bidlake.llm.labelled import labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
_LINK = re.compile(r"https?://|www\.|@\w+\.\w")
_END = (".", "!", "?", "…", '"', "'", "”", ":", ";")
#: What a line shows; each is 0 or 1.
FEATURES = (
    "always", "one_word", "under_4_words", "under_9_words", "over_20_words", "ends_sentence", "commas", "bar", "some_symbols", "many_symbols",
    "many_digits", "link", "repeated", "capitals", "short_words", "long_words", "bullet", "first", "last",
)
BOILERPLATE, CONTENT = 0, 1


def in_repeated_windows(words: list[str], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more, by exact ranks of windows (24 bytes a word)."""
    if len(words) <= width:
        return 0
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    windows, many = ids, len(index)
    for at in range(1, width):
        _, windows = np.unique(windows[:-1] * np.int64(many) + ids[at:], return_inverse=True)
    often = np.bincount(windows)[windows] > 1
    inside = np.zeros(len(words) + 1, np.int64)
    inside[: len(windows)] += often
    inside[width : width + len(windows)] -= often
    return int((np.cumsum(inside) > 0).sum())


def base_counts(text: str | None) -> dict[str, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    repeat = in_repeated_windows(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(SYMBOL.findall(text)), "n_dup_lines": dup, "n_repeat_words": repeat}


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features and the number of words for each line that has a word."""
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen: set[str] = set()
    rows, counts = [], []
    for at, line in enumerate(lines):
        words = WORD.findall(line)
        n, chars = len(words), sum(map(len, words))
        symbols, digits = len(SYMBOL.findall(line)), sum(map(line.count, "0123456789"))
        mean, body = chars / n, line.strip("\x20\t\x0b\x0c\r")
        rows.append((
            1, n == 1, n < 4, n < 9, n > 20, body.endswith(_END), line.count(",") * 25 > n, " | " in line, symbols * 50 > chars, symbols * 8 > chars,
            digits * 5 > chars, bool(_LINK.search(line)), line in seen, sum(map(str.isupper, line)) * 2 > chars, mean < 3, mean > 12,
            body[:1] in "*-•#>", at == 0, at == len(lines) - 1,
        ))
        seen.add(line)
        counts.append(n)
    return np.array(rows, "f4").reshape(-1, len(FEATURES)), np.array(counts, np.int64)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels for scores ``emit`` (lines x labels) and ``move`` (from x to); the lower label on ties."""
    if not len(emit):
        return np.zeros(0, np.int64)
    best, back = emit[0], np.zeros(emit.shape, np.int64)
    for i in range(1, len(emit)):
        step = best[:, None] + move
        back[i] = step.argmax(0)
        best = step.max(0) + emit[i]
    out = [int(best.argmax())]
    for i in range(len(emit) - 1, 0, -1):
        out.append(int(back[i][out[-1]]))
    return np.array(out[::-1])


def fit_crf(lines: list[np.ndarray], labels: list[np.ndarray], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features x 2) and moves (2 x 2) of the largest conditional likelihood, from ``start`` or zero.

    Forward and backward passes run over all sequences at once, padded to the longest.
    """
    n, longest = len(lines), max((len(x) for x in lines), default=0)
    emit_w, move = (p.copy() for p in start or (np.zeros((len(FEATURES), 2)), np.zeros((2, 2))))
    if not longest:
        return emit_w, move
    x, y, live = np.zeros((n, longest, len(FEATURES)), "f4"), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (a, b) in enumerate(zip(lines, labels, strict=True)):
        x[i, : len(a)], y[i, : len(a)], live[i, : len(a)] = a, b, True
    both = live[:, 1:] & live[:, :-1]
    flat, target = x[live], np.eye(2)[y[live]]
    moved = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    moments = [np.zeros((2, *p.shape)) for p in (emit_w, move)]
    log_add = lambda v, axis: np.logaddexp(v.take(0, axis), v.take(1, axis))
    for t in range(1, rounds + 1):
        emit = x @ emit_w
        forward, back = emit.copy(), np.zeros_like(emit)
        for i in range(1, longest):
            step = log_add(forward[:, i - 1, :, None] + move, 1) + emit[:, i]
            forward[:, i] = np.where(live[:, i, None], step, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            step = log_add(move + (emit[:, i + 1] + back[:, i + 1])[:, None, :], 2)
            back[:, i] = np.where(live[:, i + 1, None], step, 0)
        total = log_add(forward[:, -1], 1)
        chance = np.exp(forward + back - total[:, None, None])
        pair = forward[:, :-1, :, None] + move + (emit + back)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.exp(pair)[both].sum(0)
        slopes = (flat.T @ (chance[live] - target) / len(flat) + ridge * emit_w, (expected - moved) / len(flat) + ridge * move)
        for p, g, m in zip((emit_w, move), slopes, moments, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            p -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
    return emit_w, move


def _settled(emit: np.ndarray, move: np.ndarray, words: np.ndarray, label: int, least: float) -> np.ndarray:
    """The best path among those whose content share agrees with the document's label.

    A score added to every content line, the smallest that suffices of a doubling row and its halves, moves
    the share to the side of ``least`` where the label wants it; without need nothing is added.
    """
    right = lambda y: (words[y == CONTENT].sum() >= least * words.sum()) == (label == CONTENT)
    path = viterbi(emit, move)
    if right(path):
        return path
    shift = lambda x: viterbi(emit + x * np.eye(2)[CONTENT], move)
    low, high = 0.0, 0.5 if label == CONTENT else -0.5
    while not right(path := shift(high)):
        low, high = high, 2 * high
    for _ in range(6):
        middle = (low + high) / 2
        if right(again := shift(middle)):
            high, path = middle, again
        else:
            low = middle
    return path


def fit_latent(lines: list[np.ndarray], words: list[np.ndarray], labels: list[int], least_content: float = 0.5, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A field whose line labels are latent: only the label of the sequence is known, as a bound on its content share.

    Lines start with the label of their sequence, judged one by one without moves (lines of prose in bad
    sequences and boilerplate in good ones then stand out against the sequence's label). Each round decodes
    the best path that agrees with every sequence's label and fits the field to these paths, mixed ones included.
    """
    emit_w, _ = fit_crf([x[i : i + 1] for x in lines for i in range(len(x))], [np.array([k]) for x, k in zip(lines, labels, strict=True) for _ in x])
    move = np.zeros((2, 2))
    for _ in range(rounds):
        paths = [_settled(x @ emit_w, move, n, k, least_content) for x, n, k in zip(lines, words, labels, strict=True)]
        emit_w, move = fit_crf(lines, paths, 60, start=(emit_w, move))
    return emit_w, move


def training_sequences(sample: DataFrame, max_lines: int) -> DataFrame:
    """label, at, key, features and words of each run of ``max_lines`` lines of every sampled text; texts stay on the executors."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                x, n = line_features(text)
                starts = range(0, len(x), max_lines)
                runs = [(x[i : i + max_lines].astype("u1").tobytes(), n[i : i + max_lines].astype("<i8").tobytes()) for i in starts]
                yield pd.DataFrame({"doc": str(doc_id), "at": list(starts), "label": label, "features": [r[0] for r in runs], "words": [r[1] for r in runs]})

    return sample.mapInPandas(cut, "doc string, at long, label int, features binary, words binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, max_lines: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A field fitted to the lines of at most ``per_class`` labelled documents of each class, of any length.

    A text is fitted in runs of ``max_lines`` lines; at most ``per_class`` runs of each class, those with the
    smallest hashes, reach the driver, and of them only its flags and a number a line. A document labelled
    good bounds its content share from below, one labelled bad from above; which lines are content is learnt
    (:func:`fit_latent`). Empty tables and texts without words give a field that finds everything boilerplate.
    """
    sample, _ = labelled_sample(docs, labels, label, F.lit(True), per_class)
    runs = training_sequences(sample, max_lines)
    runs = saved(runs.withColumn("h", F.xxhash64("doc", "at")), "quality_runs")
    rows = [r for k in (0, 1) for r in runs.where(F.col("label") == k).orderBy("h", "doc", "at").limit(per_class).collect()]
    lines = [np.frombuffer(r["features"], "u1").reshape(-1, len(FEATURES)).astype("f4") for r in rows]
    return fit_latent(lines, [np.frombuffer(r["words"], "<i8") for r in rows], [r["label"] for r in rows])


def apply_rules(docs: DataFrame, emit_w: np.ndarray, move: np.ndarray, least_content: float = 0.5, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """doc_id, the base counts, n_content_words, base_failed and kept for every row of ``docs``.

    A text fails the base rules with under ``least_words`` words or over ``most_repeated`` percent of them
    in repeated five-word windows. Otherwise it is kept if at least ``least_content`` of its words stand
    in lines that Viterbi decoding marks as content. Null and empty texts have no words and fail. Every row is
    judged by its text alone: repeated rows fall alike, null ids stay null, further columns and their names play
    no part, and an empty table gives an empty result. A text of any length is held once with a few numbers a
    word and a line.
    """
    columns = {"doc_id": "long", **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words"), "long"), "base_failed": "boolean", "kept": "boolean"}

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                row = base_counts(text)
                x, n = line_features(text)
                content = int(n[viterbi(x @ emit_w, move) == CONTENT].sum())
                failed = row["n_words"] < least_words or 100 * row["n_repeat_words"] > most_repeated * row["n_words"]
                rows.append({**row, "n_content_words": content, "base_failed": failed, "kept": not failed and content >= least_content * row["n_words"]})
            yield pd.DataFrame(rows, columns=list(columns)[1:]).assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))[list(columns)]

    return docs.select("doc_id", "text").mapInPandas(decide, ", ".join(f"{k} {v}" for k, v in columns.items()))
