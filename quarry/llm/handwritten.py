"""Source files that nobody wrote by hand: generated, minified, vendored, or data saved as code.

Identifier-masked token shingles are clustered by MinHash banding, and each candidate is verified
by the Jaccard similarity of the shingle sets. A verified family within one repository indicates
generation, a cluster over repositories whose files share their names too vendoring, a cluster of
literals alone a blob. Marks of single files (generator headers, upstream notices, third-party folders,
dense lines) decide where a file stands alone, as most such files do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import clean_path, ensure_checkpoint_dir
from .common import current_files, spread
from .lexer import CODE_LANGUAGES, COMMENT, IDENT, NEWLINE, NUMBER, OP, SIMPLE_LANGUAGES, STRING, simple_kind, simple_tokens, tokens

SHINGLE = 16  # masked tokens; five of them repeat in all code
PLAIN = 5  # tokens as they are, by which a copy with scattered edits is verified
SIMILARITY = 0.8
BANDS, ROWS = 32, 7  # a pair of similarity 0.8 shares no band with 0.0005; of those of 0.3 0.007 share one
CERTAIN = 3.2  # standard deviations that the signatures' agreement of a pair may lie below SIMILARITY before the pair is not verified: 0.0007 of the pairs of 0.8 do
SKETCH = 32  # values of the sketch of plain shingles by which copies of one shape are told from look-alikes
AGREE = 0.82  # mean share of a shape's files that have the most frequent value: 0.89 in copies of pairwise similarity 0.8, 0.73 at 0.55
SKETCHES = 50_000  # rows of sketches up to which they are broadcast: 15 MB at most
SMALL = 500_000  # rows of keys up to which a side is broadcast: 20 MB at most
DENSE = 80  # tokens of a line that people do not write
BLOCK = 2000  # shapes of a bucket's block
FAMILY = 3  # files of one repository
USUAL = 2  # files that each repository has in the mean where a family is spread over repositories
SPREAD = 3  # repositories

# What generators write at the top of their output.
_GENERATED = re.compile(
    r"""code\ generated\ (?:by|from)|\b(?:auto-?|automatically\ |machine[- ])(?:generated|written|produced|created)\b|@generated\b|<auto-?generated|(?:^\W*|\b(?:is|was|are|been|automatically|auto)\ )generated\ (?:source|file|code|by|from|automatically|output|on\ build|class|with)\b|this\ (?:file|code|class|module)\ (?:was|is|has\ been)\ (?:auto\w*\ |automatically\ )?(?:generated|produced|written|created|emitted)\ (?:by|from|with)
      |do\ not\ (?:edit|modify|change|touch|hand-?edit|alter)\b|don'?t\ (?:edit|modify)\b|edits?\ (?:will|to\ this\ file\ will)\ be\ (?:lost|overwritten)|changes?\ (?:will\ be|made\ here\ (?:will|are)|is|are)\ (?:lost|overwritten|discarded)|any\ manual\ changes?|regenerate\ (?:with|using|by|this)|output\ of\ (?:the\ )?[\w-]+(?:\ [\w-]+)?\ (?:engine|compiler|generator|template)|written\ by\ [\w-]+(?:-compiler|-gen|-generator)|generated\ by\ [\w.-]+""",
    re.I | re.X | re.M,
)
_DENIED = re.compile(r"""["'`‘“][^"'`’”\n]{0,80}generated|(?:not|never|isn't|hand[- ]?written|says?|said|reads?|text|report)\W+(?:\w+\W+){0,4}(?:auto)?(?:generated|produced|written)|generated\s+(?:method|constructor|catch|function|getter|setter)?\s*(?:stub|block)|on purpose""", re.I)
# File names that only generators give.
_GENERATED_NAME = re.compile(r"\.pb\.(?:go|cc|h|rb|swift)$|_pb2(?:_grpc)?\.pyi?$|_pb\.(?:js|ts|d\.ts|rb)$|\.generated\.\w+$|\.g(?:\.i)?\.(?:cs|dart|ts|java)$|\.designer\.(?:cs|vb)$|(?:^|/)zz_[\w.]*(?:generated|deepcopy)[\w.]*\.go$|_gen\.go$|\.gen\.(?:go|ts|rs)$|_generated\.(?:go|rs|ts|py|rb)$|(?:^|/)__generated__/|\.xaml\.cs$|_mock\.go$|\.freezed\.dart$", re.I)
# Lock files of package managers.
_LOCK = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb?|composer\.lock|cargo\.lock|gemfile\.lock|poetry\.lock|pdm\.lock|uv\.lock|pipfile\.lock|packages\.lock\.json|go\.sum|mix\.lock|pubspec\.lock|podfile\.lock|flake\.lock|paket\.lock|gradle\.lockfile|\.terraform\.lock\.hcl)$", re.I)
# Folders that hold other projects' code. Names that own code uses as well count only above a library's folder.
_VENDOR_DIR = re.compile(r"/(?:vendor|vendors|vendored|third[-_]?party|3rdparty|node_modules|bower_components|jspm_packages|pods|carthage/(?:build|checkouts)|thirdparty|site-packages|godeps|_vendor)/|/(?:deps|external|externals|extern|ext)/[^/]+/", re.I)
_VENDOR = re.compile(r"\b(?:bundled|vendored|verbatim|local|private|embedded|modified|unmodified)\s+(?:copy|version)\s+of\b|\b(?:copied|taken|imported|vendored|ported|pulled|mirrored|synced)\s+(?:\w+\s+){0,3}from\s+(?:upstream|https?:|the\s+[\w-]+\s+(?:project|library|repository))|\bupstream\s+(?:release|version|project|source|repository|commit)\b|\b(?:library|package|module),?\s+version\s+\d|\bv?\d+\.\d+\.\d+\b[^\n]{0,30}\b(?:licen[cs]ed?|license)\b|@(?:license|preserve)\b[^\n]*\bv?\d+\.\d+|\bimported\s+unchanged\b", re.I)


class Scan(NamedTuple):
    """The tokens of a text: codes of their kinds' letters, texts, lengths, and which are neither comments nor line ends with the 64-bit codes of these."""

    kinds: np.ndarray
    texts: list[str]
    sizes: np.ndarray
    code: np.ndarray
    plain: np.ndarray

    def masked(self) -> np.ndarray:
        """The codes of the code tokens with names and literals masked."""
        kinds, out = self.kinds[self.code], self.plain.copy()
        for kind in (IDENT, STRING, NUMBER):
            out[kinds == ord(kind)] = ord(kind)
        return out


def scan(text: str, language: str) -> Scan:
    """What ``tokens`` finds; a text whose tokens need no context comes from one pass that keeps no offsets and looks each token's kind and code up."""
    texts = simple_tokens(text, language)
    if texts is not None:
        words = _WORDS[language]
        words.bound()
        ids = np.fromiter(map(words.__getitem__, texts), np.int64, len(texts))
        kinds, sizes, codes = words.kinds[ids], words.sizes[ids], words.codes[ids]
        code = (kinds != ord(COMMENT)) & (kinds != ord(NEWLINE))
        return Scan(kinds, texts, sizes, code, codes[code])
    toks = tokens(text, language)
    kinds, texts = np.frombuffer("".join([t[0] for t in toks]).encode(), np.uint8), [t[1] for t in toks]
    code = (kinds != ord(COMMENT)) & (kinds != ord(NEWLINE))
    plain = np.fromiter(map(_CODES.__getitem__, compress(texts, code.tolist())), np.int64, int(code.sum()))
    return Scan(kinds, texts, np.fromiter(map(len, texts), np.int64, len(texts)), code, plain)


def leading_comments(seen: Scan) -> str:
    """Comments before the first code, where generators and vendors put their notice."""
    first = int(seen.code.argmax()) if seen.code.any() else len(seen.texts)
    return "\n".join([seen.texts[k] for k in np.nonzero(seen.kinds[:first] == ord(COMMENT))[0]])


def leading_lines(text: str) -> str:
    """Comment lines before the first content of a text that is no code, and those of its first six lines."""
    out, until = [], ""
    for k, line in enumerate(text.split("\n")):
        x = line.strip()
        if until or re.match(r"#|//|<!--|;|/?\*", x):
            out.append(line)
            until = until or ("-->" if x.startswith("<!--") else "*/" if x.startswith("/*") else "")
            until = "" if until in x else until
        elif k >= 5 and x and not re.match(r"---|%YAML|<\?xml|<!doctype", x, re.I):
            break
        elif x and k < 5 and not re.match(r"---|%YAML|<\?xml|<!doctype", x, re.I):
            out += [y for y in text.split("\n")[k + 1 : 6] if re.match(r"\s*(?:#|//|<!--|;|/?\*)", y)]
            break
    return "\n".join(out)


def marks(path: str, language: str | None, text: str, seen: Scan | None = None) -> tuple[str | None, float, int]:
    """(verdict by the file's own marks or None, share of literals among the code's characters, number of tokens)."""
    name = "/" + path.split("/", 1)[-1]
    if _LOCK.search(path) or language in ("json", "yaml", "toml") and re.search(r"\"lockfileVersion\"\s*:|^lockfileVersion:|^# This file is automatically @generated by Cargo", text, re.M):
        return "generated", 0.0, 0
    if language not in CODE_LANGUAGES:
        if _VENDOR_DIR.search(name):
            return "vendored", 0.0, 0
        head = leading_lines(text) if language != "markdown" else ""
        return ("generated" if head and _GENERATED.search(head) and not _DENIED.search(head) else None), 0.0, 0
    seen = scan(text, language) if seen is None else seen
    kinds, texts, size, code, _ = seen
    n, total = int(code.sum()), int(size[code].sum())
    real = int(size[(kinds == ord(STRING)) | (kinds == ord(NUMBER))].sum())
    literal = real + sum(len(texts[k]) for k in np.nonzero(kinds == ord(OP))[0] if texts[k] in "[]{}(),-") if real >= 0.4 * total else real
    # tokens of each line, strings not counted
    sums = np.cumsum(code & (kinds != ord(STRING)))
    ends = np.append(np.nonzero(kinds == ord(NEWLINE))[0], len(texts) - 1)
    lines = np.diff(sums[ends], prepend=0) if len(texts) else np.zeros(0, np.int64)
    counted, packed = int(lines.sum()), int(lines[lines > DENSE].sum())
    share = literal / total if total else 0.0
    if total >= 300 and share >= 0.85 and real >= 0.6 * total:
        return "data", share, n
    if counted and packed >= 0.6 * counted:  # most of the code stands on lines of very many tokens
        return "minified", share, n
    remarks = [texts[k] for k in np.nonzero(kinds == ord(COMMENT))[0]]
    if any((t.startswith(("//# sourceMappingURL=", "//@ sourceMappingURL=")) or "webpackBootstrap" in t) for t in remarks):
        return "minified", share, n
    head = leading_comments(seen)
    if _GENERATED.search(head) and not _DENIED.search(head):
        return "generated", share, n
    if _VENDOR_DIR.search(name) or _VENDOR.search(head):
        return "vendored", share, n
    if _GENERATED_NAME.search(path):
        return "generated", share, n
    return None, share, n


def signatures(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash of the shingle codes of each of ``n`` texts: the least code of each of BANDS x ROWS bins, an empty bin taking that of the first full one in an order of its own."""
    bins = BANDS * ROWS
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    out = np.full((n, bins), _NONE, np.uint64)
    np.minimum.at(out.reshape(-1), owner * bins + (h % np.uint64(bins)).astype(np.int64), h)
    full = out != _NONE
    text, empty = np.nonzero(~full)
    for step in _ORDER:  # the first full bin in the bin's own order; few steps fill nearly all
        if not len(empty):
            break
        donor = step[empty]
        got = full[text, donor]
        out[text[got], empty[got]] = out[text[got], donor[got]]
        text, empty = text[~got], empty[~got]
    return out


_NONE = np.iinfo(np.uint64).max
# The bins from which an empty bin takes its code: each row gives every bin its next candidate.
_ORDER = np.random.default_rng(1).permuted(np.tile(np.arange(BANDS * ROWS, dtype=np.int64), (BANDS * ROWS, 1)), axis=1).T.copy()


class _Codes(dict):
    """64-bit codes of the tokens that this worker has seen."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        code = self[token] = xxhash.xxh64_intdigest(token) - (1 << 63)
        return code


_CODES = _Codes()


class _Words(dict):
    """Token of a language -> its place in the arrays of kinds, lengths and codes; comments and line ends need no code."""

    MOST = 100_000

    def __init__(self, language: str):
        self.language = language
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.used = 0
        self.kinds, self.sizes, self.codes = np.zeros(1024, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def bound(self) -> None:
        """Forget all words if there are very many; between two texts only."""
        if self.used > self.MOST:
            self.reset()

    def __missing__(self, token: str) -> int:
        import xxhash

        k = self[token] = self.used
        self.used += 1
        if k == len(self.kinds):
            self.kinds, self.sizes, self.codes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kinds, self.sizes, self.codes))
        kind = simple_kind(token, self.language)
        self.kinds[k], self.sizes[k] = ord(kind), len(token)
        if kind not in (COMMENT, NEWLINE):
            self.codes[k] = xxhash.xxh64_intdigest(token) - (1 << 63)
        return k


_WORDS = {x: _Words(x) for x in SIMPLE_LANGUAGES}


def shingled(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit code, number of its text) of all shingles of ``size`` tokens of several texts; a shorter text is one shingle."""
    lengths = np.array([len(x) for x in texts], np.int64)
    codes, owner = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    long = np.nonzero(lengths >= size)[0]
    if len(long):
        ids = np.concatenate([texts[k] for k in long]).view(np.uint64)
        of = np.repeat(long, lengths[long])
        n = len(ids) - size + 1
        within = of[:n] == of[size - 1 :]
        codes.append(_rolled(ids, size, n)[within])
        owner.append(of[:n][within])
    for k in np.nonzero((lengths > 0) & (lengths < size))[0]:
        codes.append(_rolled(texts[k].view(np.uint64), int(lengths[k]), 1))
        owner.append(np.full(1, k))
    return np.concatenate(codes), np.concatenate(owner)


def _rolled(ids: np.ndarray, size: int, n: int) -> np.ndarray:
    """The codes of the first ``n`` runs of ``size`` tokens."""
    h, shifted = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for k in range(size):
        h *= np.uint64(0x100000001B3)
        h ^= ids[k : k + n]
        np.right_shift(h, np.uint64(29), out=shifted)
        h ^= shifted
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


def distinct(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of each text, in order of text and code."""
    both = np.sort(owner.astype(np.uint64) << np.uint64(32) | codes)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both.astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)


_FILE = "filepath string, repo string, language string, verdict string, literal double, shape long, size int, bands array<long>, near binary, sketch array<tinyint>"


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of every signature."""
    sigs = sigs.reshape(-1, BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sigs), 1))
        for k in range(ROWS):
            key = (key ^ sigs[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketches(codes: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """Eight bits of the least code of each of ``size`` bins of every text, an empty one taking the next full one's: two sets agree in as many values as their similarity says."""
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    out = np.full((n, size), _NONE, np.uint64)
    np.minimum.at(out.reshape(-1), owner * size + (h % np.uint64(size)).astype(np.int64), h)
    full = out != _NONE
    last = out[np.arange(n), full.argmax(axis=1)]  # behind the last bin comes the first full one
    for k in range(size - 1, -1, -1):
        last = out[:, k] = np.where(full[:, k], out[:, k], last)
    return (out >> np.uint64(40)).astype(np.uint8).view(np.int8)


TOGETHER = 1 << 17  # tokens of the texts that are hashed in one go


def _shape(rows: list[tuple], shaped: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Shape, size, band keys and sketches into the rows of texts (number of the row, codes, masked codes)."""
    import xxhash

    if not shaped:
        return
    n = len(shaped)
    own, owner = distinct(*shingled([x[2] for x in shaped], SHINGLE))
    sigs = signatures(own, owner, n)
    values = zip(np.bincount(owner, minlength=n).tolist(), band_keys(sigs).tolist(), (sigs >> np.uint64(8)).astype(np.uint8), sketches(*shingled([x[1] for x in shaped], PLAIN), n, SKETCH).tolist(), strict=True)
    for (k, _, masked), (size, bands, near, named) in zip(shaped, values, strict=True):
        rows[k] = (*rows[k][:5], xxhash.xxh64_intdigest(masked.tobytes()) - (1 << 63), size, bands, near.tobytes(), named)


def profiled(parse_results: DataFrame) -> DataFrame:
    """One row per file: its own marks, and for code with tokens the hash of its masked tokens, the band keys and the sketches.

    Markup under a code extension, such as a saved error page, is no code that could have a shape: problem 6 finds it.
    """
    files = current_files(parse_results).where(F.col("content") != "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, shaped, held = [], [], 0
            for path, repo, lang, text in zip(pdf["filepath"], pdf["repo"], pdf["language"], pdf["content"], strict=True):
                seen = scan(text, lang) if lang in CODE_LANGUAGES else None
                verdict, share, n = marks(path, lang, text, seen)
                rows.append((path, repo, lang, verdict, share, None, None, None, None, None))
                if n and not (lang != "php" and text.lstrip()[:1] == "<"):
                    shaped.append((len(rows) - 1, seen.plain, seen.masked()))
                    held += n
                    if held >= TOGETHER:
                        _shape(rows, shaped)
                        shaped, held = [], 0
            _shape(rows, shaped)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FILE.split(", ")]).astype({"shape": "Int64", "size": "Int32"})

    return spread(files.select("filepath", "repo", "language", "content"), "filepath").mapInPandas(run, _FILE)


def _small(df: DataFrame, most: int = SMALL, rows: int | None = None) -> DataFrame:
    """A table, to be broadcast if it has ``most`` rows at most (those of keys 20 MB); ``rows`` if they have been counted."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def _sets(texts: list[np.ndarray], size: int) -> list[bytes]:
    """The different shingle codes of each text."""
    codes, owner = distinct(*shingled(texts, size))
    return [x.tobytes() for x in np.split(codes, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])]


def _shingle_sets(parse_results: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(shape, sets, plain), the masked and the plain shingles of the files in ``wanted`` (filepath, shape; checkpointed): only candidates are read again for verification."""
    own = parse_results.select("repo", "filepath", "language", "content", "parsed_at")
    few = _small(wanted, rows=rows)
    paths = _small(wanted.select(F.col("filepath").alias("path")), rows=rows)
    files = current_files(own.join(paths, clean_path(F.col("filepath")) == F.col("path"), "left_semi")).join(few, "filepath")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets, named, seen, held = [], [], [], 0
            for k, (text, lang) in enumerate(zip(pdf["content"], pdf["language"], strict=True), 1):
                seen.append(scan(text, lang))
                held += len(seen[-1].plain)
                if held >= TOGETHER or k == len(pdf):
                    sets += _sets([x.masked() for x in seen], SHINGLE)
                    named += _sets([x.plain for x in seen], PLAIN)
                    seen, held = [], 0
            yield pd.DataFrame({"shape": pdf["shape"], "sets": sets, "plain": named})

    return files.select("shape", "language", "content").mapInPandas(run, "shape long, sets binary, plain binary")


@F.pandas_udf(T.DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        both = len(np.intersect1d(p, q, assume_unique=True))
        out.append(both / max(1, len(p) + len(q) - both))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the values of two signatures that agree."""
    x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(len(a), -1) for z in (a, b))
    return pd.Series((x == y).mean(axis=1) if len(a) else np.zeros(0))


def _named_alike(a: str, b: str) -> Column:
    """Share of the values of two sketches that agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(a)


def _least_agreement(n: Column) -> Column:
    """What the agreement of ``n`` values can be by chance where the similarity is SIMILARITY."""
    return F.lit(SIMILARITY) - CERTAIN * F.sqrt(F.lit(SIMILARITY * (1 - SIMILARITY)) / n)


def _verified(candidates: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (shape, other, copied) whose masked or plain shingle sets have a Jaccard similarity of SIMILARITY or more; ``copied`` if the plain ones have.

    Signatures and sketches, a quarter kilobyte a shape, go over the pairs first; only pairs that can be
    similar by one of them move the sets.
    """
    other = sketches.select(F.col("shape").alias("other"), F.col("size").alias("osize"), F.col("near").alias("onear"), F.col("sketch").alias("osketch"))
    values = F.least("size", "osize", F.lit(BANDS * ROWS))  # a small set has no more independent values than shingles
    looks = (_named_alike("sketch", "osketch") >= _least_agreement(F.lit(SKETCH))) | (_agreement("near", "onear") >= _least_agreement(values))
    alike = candidates.join(sketches, "shape").join(other, "other").where(looks).select("shape", "other").checkpoint()
    wanted = _small(alike.select(F.explode(F.array("shape", "other")).alias("shape")).distinct(), rows=2 * alike.count())
    sets = sets.join(wanted, "shape", "left_semi")
    both = alike.join(sets, "shape").join(sets.select(F.col("shape").alias("other"), F.col("sets").alias("osets"), F.col("plain").alias("oplain")), "other")
    judged = both.select("shape", "other", (_jaccard("plain", "oplain") >= SIMILARITY).alias("copied"), (_jaccard("sets", "osets") >= SIMILARITY).alias("alike"))
    return judged.where("copied OR alike").select("shape", "other", "copied")


def components(links: DataFrame) -> DataFrame:
    """(shape, cluster): the smallest shape of the connected component of every shape that has a link (shape, other).

    Least labels go over the links, then to the label's own label, until none changes.
    """
    links = links.select("shape", "other")
    both = links.unionByName(links.select(F.col("other").alias("shape"), F.col("shape").alias("other"))).distinct().checkpoint()
    labels = both.groupBy("shape").agg(F.least("shape", F.min("other")).alias("cluster")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("shape").alias("other"), "cluster"), "other").groupBy("shape").agg(F.min("cluster").alias("near"))
        step = labels.join(near, "shape").select("shape", F.col("cluster").alias("was"), F.least("cluster", "near").alias("to"))
        jump = labels.select(F.col("shape").alias("to"), F.col("cluster").alias("further"))
        moved = step.join(jump, "to").select("shape", "was", F.least("to", "further").alias("cluster")).checkpoint()
        labels = moved.select("shape", "cluster")
        if moved.where("was <> cluster").isEmpty():
            return labels


def _in_buckets(banded: DataFrame) -> DataFrame:
    """(shape, other), shape < other: pairs of one bucket, of different clusters and of sizes not too far apart; a large bucket is met in salted blocks."""
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = banded.join(sizes, "band")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("shape"), F.col("blocks").cast("long")).cast("int"))
    right = rows.select("band", F.col("shape").alias("other"), F.col("size").alias("osize"), F.col("cluster").alias("ocluster"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    fits = (F.col("shape") < F.col("other")) & (F.col("cluster") != F.col("ocluster")) & (F.least("size", "osize") >= SIMILARITY / 2 * F.greatest("size", "osize"))
    return left.join(right, ["band", "salt"]).where(fits).select("shape", "other").distinct()


def clusters(parse_results: DataFrame, files: DataFrame) -> DataFrame:
    """(shape, cluster): each masked text with the smallest one of its verified cluster, itself if there is none.

    Files with equal masked tokens are one shape first. Each shape is compared with the smallest one
    of its band buckets; then all pairs of a bucket that this left in different clusters are compared,
    so no link is lost and copies of one text cost one comparison. Clusters are connected components.
    """
    coded = files.where("shape IS NOT NULL").select("shape", "size", "filepath", F.explode("bands").alias("band"))
    # copies of one text are one value on either side, so that they are counted before anything moves
    shared = coded.groupBy("band").agg(F.min("shape").alias("head"), F.max("shape").alias("last")).where("head <> last").select("band", "head").checkpoint()
    banded = coded.join(_small(shared), "band").groupBy("shape", "size", "band", "head").agg(F.min("filepath").alias("filepath")).checkpoint()
    wanted = banded.groupBy("shape").agg(F.min("filepath").alias("filepath")).select("filepath", "shape").checkpoint()
    n = wanted.count()
    sketches = _small(files.select("filepath", "size", "near", "sketch").join(_small(wanted, rows=n), "filepath").select("shape", "size", "near", "sketch"), SKETCHES, n)
    banded = banded.drop("filepath")
    sets = _shingle_sets(parse_results, wanted, n).checkpoint()
    stars = _verified(banded.where("shape <> head").select("shape", F.col("head").alias("other")).distinct(), sketches, sets).checkpoint()
    # shapes that the first comparison has linked to one head need none among themselves
    first = stars.groupBy("shape").agg(F.min("other").alias("to"))
    rest = banded.join(first, "shape", "left").select("band", "shape", "size", F.coalesce("to", "shape").alias("cluster"))
    links = stars.unionByName(_verified(_in_buckets(rest), sketches, sets)).checkpoint()
    copied = links.where("copied").select(F.explode(F.array("shape", "other")).alias("shape")).distinct().withColumn("copied", F.lit(True))
    return files.where("shape IS NOT NULL").select("shape").distinct().join(components(links), "shape", "left").join(copied, "shape", "left").select("shape", F.coalesce("cluster", "shape").alias("cluster"), F.coalesce("copied", F.lit(False)).alias("copied"))


def _copies(known: DataFrame) -> DataFrame:
    """(cluster) of those whose files are copies rather than look-alikes: most of them have a link by their plain shingles, or share shape and plain shingles with others.

    Files of one shape share their plain shingles where in the mean over the sketch AGREE of them have the most frequent value.
    """
    values = known.select("cluster", "shape", F.posexplode("sketch").alias("at", "value")).groupBy("cluster", "shape", "at", "value").count()
    top = values.groupBy("cluster", "shape", "at").agg(F.max("count").alias("top"), F.sum("count").alias("n"))
    shapes = top.groupBy("cluster", "shape").agg(F.avg(F.col("top") / F.col("n")).alias("agree"), F.first("n").alias("n"))
    linked = known.groupBy("cluster", "shape").agg(F.max("copied").alias("copied"))
    same = (F.col("n") > 1) & (F.col("agree") >= AGREE)
    return shapes.join(linked, ["cluster", "shape"]).groupBy("cluster").agg((F.sum(F.when(F.col("copied") | same, F.col("n")).otherwise(0)) / F.sum("n")).alias("part")).where("part > 0.5").select("cluster")


def classified(parse_results: DataFrame, use_marks: bool = True) -> DataFrame:
    """(filepath, repo, language, verdict) of every current file.

    ``verdict`` is generated, minified, vendored, data, or hand-written. A file without a mark of
    its own takes that of its cluster: a family of FAMILY or more files in its repository is
    generated (one spread over repositories if each has USUAL in the mean), a cluster over SPREAD or more repositories whose files share their names vendored
    (generated where most of its marked files are), one of literals alone data. Files without content
    give no row. Without ``use_marks`` the clusters alone decide.
    """
    ensure_checkpoint_dir(parse_results.sparkSession)
    files = profiled(parse_results).checkpoint()
    if not use_marks:
        files = files.withColumn("verdict", F.lit(None).cast("string"))
    named = clusters(parse_results, files)
    known = files.where("shape IS NOT NULL").join(named, "shape").select("filepath", "shape", "cluster", "copied", "repo", "verdict", "literal", "sketch")
    in_repo = known.groupBy("cluster", "repo").agg(F.count(F.lit(1)).alias("family"), F.avg("literal").alias("l"), F.count_if(F.col("verdict") == "generated").alias("g"), F.count_if(F.col("verdict") == "vendored").alias("v"))
    overall = in_repo.groupBy("cluster").agg(F.max("family").alias("family"), F.avg("family").alias("usual"), F.count(F.lit(1)).alias("repos"), F.avg("l").alias("l"), F.sum("g").alias("g"), F.sum("v").alias("v")).where((F.col("family") > 1) | (F.col("repos") > 1)).checkpoint()
    wide = overall.where(F.col("repos") >= SPREAD).select("cluster")
    copies = _copies(known.join(wide, "cluster", "left_semi")).withColumn("copied", F.lit(True))
    sign = (
        F.when((F.col("l") >= 0.85) & (F.col("repos") + F.col("family") > 2), "data")
        .when((F.col("repos") >= SPREAD) & (F.col("g") >= F.col("v")) & (F.col("g") > 0), "generated")
        .when((F.col("repos") >= SPREAD) & F.col("copied"), "vendored")
        .when((F.col("family") >= FAMILY) & ((F.col("repos") < SPREAD) | (F.col("usual") >= USUAL)), "generated")
    )
    by_cluster = overall.join(copies, "cluster", "left").select("cluster", sign.alias("sign")).where("sign IS NOT NULL")
    signs = known.select("filepath", "cluster").join(by_cluster, "cluster").select("filepath", "sign")
    return files.select("filepath", "repo", "language", "verdict").join(signs, "filepath", "left").select("filepath", "repo", "language", F.coalesce("verdict", "sign", F.lit("hand-written")).alias("verdict"))


def not_handwritten(parse_results: DataFrame) -> DataFrame:
    """(filepath) of the files to leave out."""
    return classified(parse_results).where(F.col("verdict") != "hand-written").select("filepath")
