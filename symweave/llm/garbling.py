"""Garbled text from a wrong character encoding (problem 8).

Clean stretches of the corpus are garbled synthetically by every known chain of encodings, and a multinomial model of
hashed byte bigrams learns to tell the chains and clean text apart. A stretch that the model gives to a chain is
encoded and decoded back along it; only if every step is strictly possible it counts as garbled by that chain. The
chains found in a text are then held against its other stretches, where less evidence is enough.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the training sample: texts that are looked at, and distinct stretches taken from them.
SAMPLE_TEXTS, SAMPLE_STRETCHES = 4000, 6000
BUCKETS, SMOOTHING = 1 << 14, 0.02
#: How much likelier (natural logarithm) than clean text a chain must be: without and with UTF-8 bytes as a witness.
MARGIN, MARGIN_UTF8 = 4.0, 1.0
#: How much more plausible (natural logarithm for a byte pair) the original must be as clean text.
PLAUSIBLE = 1.0
#: The same for all byte pairs together, for chains without UTF-8: within a word, with signs or single letters, and where the chain is known from the same text.
PLAUSIBLE_TOTAL, PLAUSIBLE_SIGNS, PLAUSIBLE_KNOWN = 8.0, 24.0, 2.0
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: A word that holds a character outside ASCII, with what follows up to white space, a quote or a bracket; braces can be the second byte of a character.
STRETCH = r'[A-Za-z]*+[^\x00-\x7F](?:[^\x00-\x20"<>(){}]|(?<=[^\x00-\x7F])[{}])*+'
LOST = "�"
#: The first bytes of a character in UTF-8 without the last one; one of three bytes after its first one could be a whole letter.
_CUT_OFF = re.compile(rb"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{1,2})\Z")
#: A character outside ASCII in UTF-8, and what is left of one that lost bytes.
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_REST = re.compile(rb"[\xc2\xc3](?![\x80-\xbf])|" + _CUT_OFF.pattern)

# Encodings texts are written in, and those they are wrongly read in.
SINGLE = ("cp1252", "latin-1", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "cp852", "iso8859_15", "cp1254", "mac_cyrillic", "iso8859_5")
WRITTEN = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_roman", "cp850", "mac_cyrillic", "cp932", "euc_jp")
READ = ("cp1252", "latin-1", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850")
DOUBLED = ("cp1252", "latin-1", "cp1251", "cp1250", "mac_roman", "cp437", "cp850")

#: A chain is a tuple of (written in, read in) steps in the order in which they happened.
Chain = tuple[tuple[str, str], ...]


def chains() -> list[Chain]:
    """All chains the model knows: UTF-8 read wrongly once, twice and thrice, and other encodings mixed up once."""
    once = [(("utf-8", r),) for r in (*SINGLE, "cp932", "gbk")]
    twice = [(("utf-8", r),) * 2 for r in DOUBLED] + [(("utf-8", "cp1252"), ("utf-8", "latin-1")), (("utf-8", "latin-1"), ("utf-8", "cp1252"))]
    thrice = [(("utf-8", r),) * 3 for r in ("cp1252", "latin-1")]
    return once + twice + thrice + [((w, r),) for w in WRITTEN for r in READ if w != r and {w, r} != {"cp1252", "latin-1"}]


@functools.cache
def _table(codec: str) -> tuple[str, dict[int, int]] | None:
    """Of a single-byte encoding, the character of each byte, undefined bytes as control characters, and back."""
    if codec not in SINGLE:
        return None
    of = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    return of, {ord(c): b for b, c in enumerate(of)}


#: Characters that no single-byte encoding leads to.
_FOREIGN = re.compile(f"[^{re.escape(''.join(sorted({c for codec in SINGLE for c in _table(codec)[0]})))}]+")


def encode(text: str, codec: str) -> bytes | None:
    """The bytes of text, or None if it can't be written in the encoding."""
    if table := _table(codec):
        try:
            return bytes(map(table[1].__getitem__, map(ord, text)))
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeError:
        return None


def decode(data: bytes, codec: str) -> str | None:
    """The text of bytes, or None if they aren't valid in the encoding."""
    if table := _table(codec):
        return "".join(map(table[0].__getitem__, data))
    try:
        return data.decode(codec)
    except UnicodeError:
        return None


def garble(text: str, chain: Chain) -> str | None:
    """What becomes of text along the chain; None if it can't be written so."""
    for written, read in chain:
        data = None if text is None else encode(text, written)
        text = None if data is None else decode(data, read)
    return text


def invert(text: str, chain: Chain) -> str | None:
    """The original of text along the chain; None unless every step back is strictly possible and changes the text."""
    start = text
    for written, read in reversed(chain):
        data = None if text is None else encode(text, read)
        text = None if data is None else decode(data, written)
    return None if text == start else text


def invert_runs(text: str, chain: Chain) -> tuple[str, bool] | None:
    """Text with the runs put right that can be taken back along the chain, and whether a part of a character is left.

    None unless there are such runs for every step.
    """
    broken = False
    for written, read in reversed(chain):
        out, start, coded = [], text, [(c, encode(c, read)) for c in text]
        for known, part in itertools.groupby(coded, key=lambda p: p[1] is not None):
            chars = list(part)
            if not known:
                if written != "utf-8" and any(c.isalpha() and not _FOREIGN.match(c) for c, _ in chars):
                    return None  # a letter within the word that the encoding doesn't have
                out.append("".join(c for c, _ in chars))
                continue
            data, rest = b"".join(b for _, b in chars), []
            if written == "utf-8":
                at, ends = 0, list(itertools.accumulate((len(b) for _, b in chars), initial=0))
                place = {e: k for k, e in enumerate(ends)}
                for sequence in _utf8_runs(data, place):
                    out += [c for c, _ in chars[place[at] : place[sequence[0]]]] + [data[slice(*sequence)].decode("utf-8")]
                    rest.append(data[at : sequence[0]])
                    at = sequence[1]
                out += [c for c, _ in chars[place[at] :]]
                broken |= _REST.search(data[at:]) is not None or any(_REST.search(r) for r in rest)
            else:
                read_back = data.decode(written, "surrogateescape")
                lost = sum("\udc80" <= c <= "\udcff" for c in read_back)
                if lost > 1:
                    return None
                broken |= lost > 0
                out += [decode(bytes([ord(c) - 0xDC00]), read) or c if "\udc80" <= c <= "\udcff" else c for c in read_back]
        text = "".join(out)
        if text == start:
            return None
    return text, broken


def _utf8_runs(data: bytes, bounds: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Start and end of the runs of UTF-8 outside ASCII that begin and end with whole characters of what was read."""
    start = end = last = -1
    for m in _UTF8.finditer(data):
        if m.start() != last:
            if end > start >= 0:
                yield start, end
            start = end = -1
        last = m.end()
        if start < 0 and m.start() in bounds:
            start = m.start()
        if start >= 0 and last in bounds:
            end = last
    if end > start >= 0:
        yield start, end


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of all byte pairs that aren't plain ASCII, and the position after each text's last one."""
    data = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
    pair = data[:-1] * 256 + data[1:]
    keep = (data[:-1] > 127) | (data[1:] > 127)
    return ((pair * 40503) >> 3)[keep] % BUCKETS, np.cumsum(keep)[np.cumsum(sizes) - 1] if len(texts) else np.zeros(0, np.int64)


@dataclass
class Model:
    """Log likelihoods by bucket and class; class 0 is clean text, class i the chain i - 1."""

    weights: np.ndarray
    known: list[Chain]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each class's log likelihood for each text, and the byte pairs of each text."""
        buckets, ends = _bigrams(texts)
        summed = np.vstack([np.zeros((1, self.weights.shape[1])), np.cumsum(self.weights[buckets], axis=0, dtype=np.float64)])
        at = np.concatenate(([0], ends))
        return np.diff(summed[at], axis=0), np.diff(at)

    def judge(self, texts: list[str]) -> list[tuple[Chain, str | None] | None]:
        """For each text None if it is clean, else its chain and original; ((), None) if characters are lost for good.

        Of the chains that the model finds likelier than clean text, the likeliest one counts whose steps can be
        taken back strictly and lead to a text that is more plausible, by PLAUSIBLE, than what is there.
        """
        found: list[tuple[Chain, str | None] | None] = []
        for at in range(0, len(texts), 512):
            part = texts[at : at + 512]
            total, n = self.scores(part)
            gain, clean = total[:, 1:] - total[:, :1], total[:, 0] / np.maximum(n, 1)
            likely = (gain > np.minimum(MARGIN_UTF8, MARGIN)).any(axis=1)
            for text, row, own, size, some in zip(part, gain, clean, n, likely):
                verdict = ((), None) if LOST in text else None
                if some and verdict is None:
                    order = sorted(np.argsort(-row), key=lambda i: self.known[i][-1][0] != "utf-8")  # strict UTF-8 is the stronger witness
                    order = [i for i in order if row[i] > (MARGIN_UTF8 if self.known[i][-1][0] == "utf-8" else MARGIN)]
                    back = [(i, invert(text, self.known[i])) for i in order]
                    back = [(i, t) for i, t in back if t is not None and LOST not in t and not CONTROL.search(t)]
                    if back:
                        verdict = self._best(text, back, own, int(size))
                    if verdict is None:
                        verdict = self._runs(text, order, own, int(size))
                found.append(verdict)
        return self._between(texts, found)

    def _runs(self, text: str, order: list[int], own: float, size: int) -> tuple[Chain, str | None] | None:
        """The verdict for a text that can't be taken back as a whole, by the runs in it that can."""
        runs = {i: r for i in order if (r := invert_runs(text, self.known[i])) and LOST not in r[0]}
        verdict = self._best(text, [(i, t) for i, (t, _) in runs.items()], own, size) if runs else None
        if verdict is None:
            return None
        whole = [t for i, (t, broken) in runs.items() if self.known[i] == verdict[0] and not broken and not CONTROL.search(t)]
        return verdict[0], whole[0] if whole else None

    def _between(self, texts: list[str], found: list[tuple[Chain, str | None] | None]) -> list[tuple[Chain, str | None] | None]:
        """The verdicts; clean texts with characters that single-byte encodings don't lead to are looked at again between those."""
        parts = {at: [p for p in _FOREIGN.split(t) if not p.isascii()] for at, (t, v) in enumerate(zip(texts, found)) if v is None and _FOREIGN.search(t)}
        inner = list(dict.fromkeys(p for ps in parts.values() for p in ps))
        verdicts = {p: v for p, v in zip(inner, self.judge(inner)) if v and v[0]} if inner else {}
        for at, own in parts.items():
            hits = [verdicts[p] for p in own if p in verdicts]
            if hits:
                whole = all(v[1] is not None for v in hits)
                found[at] = hits[0][0], "".join(verdicts[p][1] if p in verdicts else p for p in re.split(f"({_FOREIGN.pattern})", texts[at])) if whole else None
        return found

    def _best(self, text: str, back: list[tuple[int, str]], own: float, size: int) -> tuple[Chain, str] | None:
        """The first of the possible originals, in order of likelihood, that is plausible enough."""
        total, n = self.scores([t for _, t in back])
        for (i, original), clean, pairs in zip(back, total[:, 0], n):
            mean = clean / pairs if pairs else 0.0
            if mean - own > PLAUSIBLE and (self.known[i][-1][0] == "utf-8" or clean - own * size > (PLAUSIBLE_TOTAL if _is_word(text, original) else PLAUSIBLE_SIGNS) and _spaces_kept(text, original)):
                return self.known[i], original
        return None

    def follow(self, texts: list[str], found: dict[Chain, int]) -> list[tuple[Chain, str | None] | None]:
        """As judge, for stretches without a verdict in a text where chains were found so many times.

        What can be taken back strictly along such a chain counts: with UTF-8 always, else if the original is more
        plausible or the chain likelier than clean text. What can't, but is likelier garbled than clean and ends in the
        midst of a character, stays as a case without an original.
        """
        at = {chain: self.known.index(chain) for chain in sorted(found, key=lambda c: (-found[c], c))}
        verdicts: list[tuple[Chain, str | None] | None] = []
        for text, row in zip(texts, self.scores(texts)[0]):
            back = [(c, t) for c in at if (t := invert(text, c)) is not None and LOST not in t and not CONTROL.search(t)]
            scored = self.scores([t for _, t in back])[0]
            gains = [(c[-1][0] == "utf-8", p - row[0], c, t) for (c, t), p in zip(back, scored[:, 0]) if c[-1][0] == "utf-8" or p - row[0] > PLAUSIBLE_KNOWN or row[at[c] + 1] - row[0] > MARGIN]
            verdict = max(gains, key=lambda g: g[:2])[2:] if gains else None
            if verdict is None:
                stays = [c for c, i in at.items() if row[i + 1] - row[0] > MARGIN_UTF8 and _cut_off(text, c)]
                verdict = (stays[0], None) if stays else None
            verdicts.append(verdict)
        return verdicts


def _is_word(text: str, original: str) -> bool:
    """Whether single characters were mixed up within a word: of two letters at least."""
    changed = [(a, b) for a, b in zip(text, original) if a != b]
    return sum(c.isalpha() for c in original) > 1 and (len(text) != len(original) or all(b.isalpha() for a, b in changed))


def _spaces_kept(text: str, original: str) -> bool:
    """Whether no space would become another character: they are correct in any text and say nothing about its encoding."""
    return len(text) != len(original) or not any(a.isspace() and a != b for a, b in zip(text, original))


def _cut_off(text: str, chain: Chain) -> bool:
    """Whether text ends in the midst of a character, as UTF-8 read along the chain."""
    written, read = chain[-1]
    data = encode(text, read) if written == "utf-8" else None
    return data is not None and _CUT_OFF.search(data) is not None


def _utf8_inside(text: str) -> bool:
    """Whether text can be read back as UTF-8 that was read in a single-byte encoding."""
    return any((u := invert(text, (("utf-8", r),))) is not None and len(u) < len(text) for r in SINGLE)


def _fit(texts: list[str], counts: list[int], spark: SparkSession, known: list[Chain]) -> Model:
    """Garbles the bounded sample by each chain, in Spark, and counts the bigrams."""
    sample = spark.sparkContext.broadcast((texts, counts))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, times = sample.value
        for b in batches:
            rows = []
            for c in b["class"].tolist():
                pairs = [(t if c == 0 else garble(t, known[c - 1]), t, n) for t, n in zip(own, times)]
                used = [(g, n) for g, t, n in pairs if g is not None and (c == 0 or g != t)]
                buckets, ends = _bigrams([g for g, _ in used])
                weight = np.repeat([float(n) for _, n in used], np.diff(np.concatenate(([0], ends)))) if used else np.zeros(0)
                rows.append(np.bincount(buckets, weight, BUCKETS).astype(np.float32))
            yield pd.DataFrame({"class": b["class"], "counts": rows})

    classes = spark.range(0, len(known) + 1).repartition(8).selectExpr("cast(id as int) AS class")
    counted = classes.mapInPandas(learn, "class int, counts array<float>").toPandas().sort_values("class")
    table = np.stack(counted["counts"].to_numpy()).T + SMOOTHING
    return Model(np.log(table / table.sum(axis=0)).astype(np.float32), known)


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_stretches: int = SAMPLE_STRETCHES) -> Model:
    """The model, fitted on at most sample_stretches distinct stretches of at most sample_texts texts of the corpus.

    The sample follows a hash of the ids, so it is the same in every run. Stretches that look garbled already are
    left out: those that hide UTF-8, and those that a first model gives an original which is more frequent than they
    are. A corpus without such text gives a
    model that finds nothing but lost characters.
    """
    spark = docs.sparkSession
    # A bounded sample: ids are drawn by their hash, about twice as many as are taken, so that no task gathers texts.
    n = docs.count()
    share = min(1.0, 4 * sample_texts / max(n, 1))
    drawn = docs.where((F.xxhash64("doc_id") / 2.0**63 < 2 * share - 1) & F.col("text").rlike(r"[^\x00-\x7F]"))
    some = drawn.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_texts)
    parts = some.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(STRETCH), F.lit(0)))).alias("stretch"))
    top = parts.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.xxhash64("stretch")).limit(sample_stretches).collect()
    known = chains()
    clean = {r.stretch: r.n for r in top if LOST not in r.stretch and not _utf8_inside(r.stretch)}
    for _ in range(2):
        model = _fit(list(clean), list(clean.values()), spark, known)
        verdicts = dict(zip(clean, model.judge(list(clean))))
        garbled = {t for t, v in verdicts.items() if v and clean.get(v[1], 0) > clean[t]}
        if not garbled:
            break
        clean = {t: n for t, n in clean.items() if t not in garbled}
    return _fit(list(clean), list(clean.values()), spark, known) if garbled else model


def held_out_accuracy(model: Model, docs: DataFrame, stretches: int = 2000) -> DataFrame:
    """(chain, n, n_found, n_chain, n_restored) of each chain: clean stretches of texts that the model wasn't fitted on, garbled and judged alone.

    n_found are judged garbled, n_chain by the very chain, n_restored get exactly their original back. At most so many
    distinct stretches are drawn, by a hash; those that the model takes for garbled as they are don't count.
    """
    spark = docs.sparkSession
    parts = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(STRETCH), F.lit(0)))).alias("stretch")).distinct()
    drawn = [r.stretch for r in parts.orderBy(F.xxhash64("stretch"), "stretch").limit(stretches).collect()]
    shared = spark.sparkContext.broadcast((model, [t for t, v in zip(drawn, model.judge(drawn)) if v is None]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, clean = shared.value
        for b in batches:
            rows = []
            for i in b["id"].tolist():
                chain = m.known[i]
                pairs = [(t, g) for t in clean if (g := garble(t, chain)) is not None and g != t and LOST not in g]
                verdicts = m.judge([g for _, g in pairs])
                found = [(t, v) for (t, _), v in zip(pairs, verdicts) if v is not None]
                rows.append((" ".join("{}>{}".format(*step) for step in chain), len(pairs), len(found), sum(v[0] == chain for _, v in found), sum(v[1] == t for t, v in found)))
            yield pd.DataFrame(rows, columns=["chain", "n", "n_found", "n_chain", "n_restored"])

    return spark.range(len(model.known)).repartition(8).mapInPandas(judge, "chain string, n bigint, n_found bigint, n_chain bigint, n_restored bigint")


def _in_context(model: Model, parts: list[str], seen: dict[str, tuple | None]) -> list[tuple[str, tuple | None]]:
    """The stretches of a text with their verdicts, after the chains found in it were held against its other stretches."""
    found = Counter(v[0] for t in parts if (v := seen[t]) and v[0])
    left = [t for t in parts if seen[t] is None or seen[t][0] and seen[t][1] is None] if found else []
    more = dict(zip(left, model.follow(left, found))) if left else {}
    return [(t, more.get(t) or seen[t]) for t in parts]


def _put_right(text: str, originals: dict[str, str]) -> str:
    """The text with its stretches replaced, only where they stand as a whole."""
    return re.sub(STRETCH, lambda m: originals.get(m.group(), m.group()), text)


def garbled_texts(docs: DataFrame, model: Model | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, stretches): each text with garbled stretches, as structs of stretch, chain and original.

    chain lists the steps as "written>read", empty if characters are lost; original is null where it can't be
    restored. Null, empty and plain ASCII texts are no case. with_text adds the whole text with all that can be
    restored put right.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or train(docs))
    cases = docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select(
        "doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit(STRETCH), F.lit(0))).alias("parts"), *(["text"] if with_text else [])
    )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple | None] = {}
        for b in batches:
            own = b["parts"].tolist()
            new = [t for t in dict.fromkeys(t for parts in own for t in parts) if t not in seen]
            if len(seen) > 500_000:
                seen, new = {}, list(dict.fromkeys(t for parts in own for t in parts))
            seen.update(zip(new, shared.value.judge(new)))
            verdicts = [_in_context(shared.value, list(parts), seen) for parts in own]
            hits = [[(t, ["{}>{}".format(*s) for s in v[0]], v[1]) for t, v in vs if v] for vs in verdicts]
            rows = b[["doc_id"]].assign(stretches=[[dict(zip(("stretch", "chain", "original"), h)) for h in hs] for hs in hits])
            if with_text:
                rows["restored"] = [_put_right(text, {h[0]: h[2] for h in hs if h[2]}) if hs else text for text, hs in zip(b["text"], hits)]
            yield rows[[bool(hs) for hs in hits]]

    schema = "doc_id bigint, stretches array<struct<stretch string, chain array<string>, original string>>"
    return cases.mapInPandas(find, schema + ", restored string" * with_text)
