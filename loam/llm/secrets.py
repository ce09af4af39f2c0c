"""Secrets in text: fixed patterns, and a linear-chain conditional random field.

The field tags tokens as begin (B), inside (I) or outside (O) of a secret from token
shape, neighbouring words and features of the whole text. B and I are admissible for
every token of at least ``LEAST`` secret characters, so only shorter tokens are always O,
chains split exactly at them, and only runs of admissible tokens need decoding.
It is trained here, by maximum likelihood, on lines made from templates under a fixed
seed; no text of the corpus is needed for that.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import narrow_input

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "crf")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Least length of a token that can be part of a secret.
LEAST = 8
_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+|[^\sA-Za-z0-9+/_.-]")
_HEX_CHARS = frozenset("0123456789abcdef")
_SECRET_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")
#: Tokens before a token that its features see.
BEHIND = 6

LABELS = "OBI"
#: Tokens of the training lines that a feature must occur on.
FREQUENT = 4
_ROUNDS, _RATE, _DECAY = 12, 0.5, 1e-4

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _bucket(n: float, steps: tuple[float, ...]) -> int:
    return sum(n >= s for s in steps)


@lru_cache(maxsize=1 << 15)
def _shape(
    n: int, digits: int, upper: int, lower: int, turns: int, distinct: int, hexes: bool, rises: int, dots: bool, slash: bool, minus: bool
) -> tuple[tuple[str, ...], str]:
    """Features that follow from counts of a token's characters, and the part of joint features."""
    marks = n - digits - upper - lower
    kinds = f"{'d' * (digits > 0)}{'U' * (upper > 0)}{'l' * (lower > 0)}{'m' * (marks > 0)}"
    case = -1 if digits else 1 + _bucket(rises / n, (0.1, 0.15, 0.2, 0.25)) if rises else 0
    share = f"dig{_bucket(digits / n, (0.1, 0.3, 0.5, 0.7, 0.99))}"
    return (
        "bias", f"len{_bucket(n, (12, 16, 20, 24, 32, 40, 64))}", f"kinds{kinds}", share,
        f"turn{_bucket(turns, (2, 4, 6, 9))}", f"div{_bucket(distinct / n, (0.2, 0.4, 0.6, 0.8))}", f"marks{_bucket(marks, (1, 2, 3, 5))}",
        f"hex{hexes}", f"{kinds}|len{_bucket(n, (12, 16, 24, 32))}|turn{_bucket(turns, (2, 4, 6))}",
        f"dots{dots}|slash{slash}|minus{minus}", f"{kinds}|case{case}",
    ), share


def _own(token: str) -> tuple[tuple[str, ...], str, str]:
    """Features of a token's shape and of its start, and the part of joint features."""
    n, kinds = len(token), set(token)
    if token.isalpha() and (token.islower() or token[1:].islower()):
        upper = int(not token.islower())
        names, joint = _shape(n, 0, upper, n - upper, 0, len(kinds), kinds <= _HEX_CHARS, 0, False, False, False)
    else:
        digits = sum(c.isdigit() for c in token)
        upper = sum("A" <= c <= "Z" for c in token)
        lower = sum("a" <= c <= "z" for c in token)
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
        rises = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False))
        names, joint = _shape(n, digits, upper, lower, turns, len(kinds), kinds <= _HEX_CHARS, rises, "." in kinds, "/" in kinds, "-" in kinds)
    return names, f"start:{token[:4]}", joint


def _file_features(text: str) -> tuple[str, ...]:
    code = sum(c in text for c in "{};=<>")
    return f"code:{_bucket(code, (1, 3, 5))}", f"lines:{_bucket(text.count(chr(10)), (1, 10, 100))}"


def _around(joint: str, before: list[str], after: list[str], place: int, gap: str) -> set[str]:
    """Features of a token's surroundings; ``gap`` is what parts it from the token before in its chain."""
    names = {f"place:{min(place, 3)}", f"right:{after[0] if after else ''}", f"gap:{gap}"}
    words = 0
    for i, w in enumerate(reversed(before)):
        if i < 2:
            names.add(f"left{i}:{w}")
        if w[0].isalpha():
            lower = w.lower()
            names.add(f"word:{lower}")
            if not words:
                names.add(f"joint:{lower}|{joint}")
            words += 1
            if words == 3 and i:
                break
    return names


def _admissible(token: str) -> bool:
    return len(token) >= LEAST and (token[-1] not in ".-/" or len(token.rstrip(".-/")) >= LEAST) and token[0] in _SECRET_CHARS


def _runs(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """Maximal runs of admissible tokens."""
    first = -1
    for i, token in enumerate(tokens):
        if len(token) >= LEAST and _admissible(token):
            if first < 0:
                first = i
        elif first >= 0:
            yield first, i
            first = -1
    if first >= 0:
        yield first, len(tokens)


def _gap(between: str, one: int, two: int) -> str:
    """Blanks or a new line between tokens of these lengths, and whether the first fills a line as long as the second's or longer."""
    return f"{'line' if chr(10) in between else 'blank'}|{one >= 40 and two <= one + 1}"


def _chains(text: str, wanted: list[tuple[int, int]] | None = None) -> Iterator[tuple[list[tuple[int, int]], list[set[str]]]]:
    """Runs of admissible tokens, or the ``wanted`` ones: their places in the text, without marks that end them, and their features."""
    found = list(_TOKEN.finditer(text))
    tokens = [m[0] for m in found]
    document = _file_features(text)
    for first, last in _runs(tokens) if wanted is None else wanted:
        spans = [(m.start(), m.start() + len(m[0].rstrip(".-/"))) for m in found[first:last]]
        names = []
        for i in range(first, last):
            gap = _gap(text[found[i - 1].end() : found[i].start()], len(tokens[i - 1]), len(tokens[i])) if i > first else ""
            shape, start, joint = _own(text[slice(*spans[i - first])])
            names.append({*shape, start, *document, *_around(joint, tokens[max(0, i - BEHIND) : i], tokens[i + 1 : i + 2], i - first, gap)})
        yield spans, names


class Field:
    """A linear chain over O, B, I with O outside the chain; I never follows O.

    Features are those that training has seen ``FREQUENT`` times or more; others weigh nothing.
    """

    def __init__(self, seen: Iterable[set[str]]) -> None:
        counts = Counter(name for names in seen for name in names)
        self.index = {name: k for k, name in enumerate(sorted(n for n, c in counts.items() if c >= FREQUENT))}
        self.emit = np.zeros((len(self.index), 3))
        self.step = np.zeros((3, 3))
        self.step[0, 2] = -1e4
        self.bounds: _Bounds | None = None

    def features(self, names: Iterable[str]) -> np.ndarray:
        return np.array(sorted(self.index[n] for n in names if n in self.index), np.int64)

    def encode(self, text: str) -> Iterator[tuple[list[tuple[int, int]], list[np.ndarray]]]:
        for spans, names in _chains(text):
            yield spans, [self.features(n) for n in names]

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in features])

    def label(self, text: str) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
        """Chains and their best labels, but for chains that a bound shows to be all O."""
        self.bounds = self.bounds or _Bounds(self)
        wanted = list(self.bounds.open_runs(_TOKEN.findall(text)))
        if wanted:
            for spans, names in _chains(text, wanted):
                yield spans, self.viterbi([self.features(n) for n in names])

    def viterbi(self, features: list[np.ndarray]) -> list[int]:
        return self.decode(self.scores(features))

    def decode(self, emit: np.ndarray) -> list[int]:
        best, back = emit[0] + self.step[0], []
        for e in emit[1:]:
            through = best[:, None] + self.step
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + e
        path = [int((best + self.step[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def learn(self, features: list[np.ndarray], labels: list[int], rate: float) -> None:
        """One gradient step on the log-likelihood, by forward-backward."""
        self.bounds = None
        emit = self.scores(features)
        n = len(emit)
        forward, backward = np.zeros((n, 3)), np.zeros((n, 3))
        forward[0] = self.step[0] + emit[0]
        for t in range(1, n):
            forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + self.step, axis=0) + emit[t]
        backward[-1] = self.step[:, 0]
        for t in range(n - 2, -1, -1):
            backward[t] = np.logaddexp.reduce(self.step + emit[t + 1] + backward[t + 1], axis=1)
        total = np.logaddexp.reduce(forward[-1] + backward[-1])
        marginal = np.exp(forward + backward - total)
        moves = np.zeros((3, 3))
        path = [0, *labels, 0]
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += 1
        moves[0] -= marginal[0]
        moves[:, 0] -= marginal[-1]
        for t in range(1, n):
            moves -= np.exp(forward[t - 1][:, None] + self.step + emit[t] + backward[t] - total)
        for t, f in enumerate(features):
            self.emit[f] += rate * (np.eye(3)[labels[t]] - marginal[t])
        self.emit *= 1 - _DECAY * rate
        self.step += rate * moves
        self.step[0, 2] = -1e4


class _Gains(dict):
    """Gains by word, as it is written; those of further spellings are looked up once, as long as they are few."""

    def __init__(self, words: dict[str, float]) -> None:
        super().__init__()
        self.lower = words

    def __missing__(self, token: str) -> float:
        gain = self.lower.get(token.lower(), 0.0)
        if len(self) < 1 << 18:
            self[token] = gain
        return gain


class _Bounds:
    """How much can at most speak for a token: what it is, the words around it, and the transitions.

    If no run of labels B and I gains on O by that, O is the best path, and the features needn't be looked up.
    """

    def __init__(self, field: Field) -> None:
        self.field = field
        gains = np.maximum(field.emit[:, 1], field.emit[:, 2]) - field.emit[:, 0]
        most: dict[str, float] = defaultdict(float)
        self.right: dict[str, float] = {}
        by_word: dict[tuple[str, str], float] = defaultdict(float)
        for name, k in field.index.items():
            kind, _, value = name.partition(":")
            gain = max(float(gains[k]), 0.0)
            most[kind] = max(most[kind], gain)
            if kind == "right":
                self.right[value] = gain
            elif kind in ("left0", "left1", "word", "joint"):
                word = (value.rpartition("|")[0] if kind == "joint" else value).lower()
                by_word[kind, word] = max(by_word[kind, word], gain)
        words: dict[str, float] = defaultdict(float)
        for (_, word), gain in by_word.items():
            words[word] += gain
        self.words = _Gains(words)
        # The first token of a chain has gap "", and others what training saw.
        self.rest = most["place"] + most["gap"] + most["code"] + most["lines"]
        stay = field.step[0, 0]
        self.inner = float(field.step[1:, 1:].max() - stay)
        self.ends = float(field.step[0, 1] - stay + field.step[1:, 0].max() - stay)
        self.own: dict[str, float] = {}
        # There are as many shapes as combinations of a few buckets.
        self.shapes: dict[tuple[str, ...], list[float]] = {}

    def _own_gain(self, token: str) -> float:
        found = self.own.get(token)
        if found is None:
            shape, start, _ = _own(token.rstrip(".-/"))
            weights = self.shapes.get(shape)
            if weights is None:
                weights = self.shapes[shape] = self.field.emit[self.field.features(shape)].sum(axis=0).tolist()
            o, b, i = weights
            k = self.field.index.get(start)
            if k is not None:
                x, y, z = self.field.emit[k].tolist()
                o, b, i = o + x, b + y, i + z
            found = max(b, i) - o + self.rest
            if len(self.own) < 1 << 18:
                self.own[token] = found
        return found

    def open_runs(self, tokens: list[str]) -> Iterator[tuple[int, int]]:
        """Runs of admissible tokens that may hold a secret."""
        known = None
        for first, last in _runs(tokens):
            if known is None:
                known = [0.0, *accumulate(map(self.words.__getitem__, tokens))]
            # The best run of labels other than O so far that ends here, and of all.
            run = best = -1e9
            for i in range(first, last):
                gain = self._own_gain(tokens[i]) + known[i] - known[max(0, i - BEHIND)]
                gain += self.right.get(tokens[i + 1] if i + 1 < len(tokens) else "", 0.0)
                run = gain + max(0.0, run + self.inner)
                best = max(best, run)
            if best + self.ends >= -1e-9:
                yield first, last


def _training_lines(seed: int = 7, lines: int = 1600) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Lines with the spans of their secrets, from templates."""
    rng = random.Random(seed)
    letters, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: pick(letters, rng.randint(2, 9))
    digits = lambda n: pick("0123456789", n)
    mixed = letters + upper + "0123456789"
    secrets = [
        lambda: pick("0123456789abcdef", rng.choice((24, 32, 40, 64))), lambda: "AKIA" + pick(upper + "234567", 16),
        lambda: "ghp_" + pick(mixed, 36), lambda: "sk-" + pick(mixed, 40), lambda: f"xoxb-{digits(12)}-{pick(mixed, 24)}",
        lambda: pick(mixed + "+/", rng.randint(20, 48)), lambda: pick(mixed, rng.randint(16, 40)), lambda: pick(letters + upper, rng.randint(16, 40)),
        lambda: pick(letters, 2) + "_" + rng.choice(("live", "test", "prod")) + "_" + pick(mixed, rng.randint(20, 32)),
        lambda: ".".join(pick(mixed + "_-", n) for n in (rng.randint(18, 36), rng.randint(30, 60), rng.randint(30, 43))),
        lambda: pick(upper + "0123456789", rng.randint(18, 40)), lambda: pick(mixed + "_-", rng.randint(24, 64)),
    ]
    cap = lambda w: w[0].upper() + w[1:]
    plain_words = [
        lambda: pick(letters, rng.randint(8, 15)), lambda: cap(pick(letters, rng.randint(8, 18))), lambda: pick(letters, rng.randint(10, 24)),
        lambda: pick(upper, rng.randint(8, 20)), lambda: "-".join(word() for _ in range(rng.randint(2, 4))) + "word", lambda: f"{word()}_{word()}_{word()}word",
        lambda: word() + "".join(cap(pick(letters, rng.randint(4, 9))) for _ in range(rng.randint(1, 3))), lambda: "".join(cap(pick(letters, rng.randint(4, 9))) for _ in range(rng.randint(2, 4))),
        lambda: f"{word()}.{word()}.com/{word()}", lambda: f"{word()}/{word()}/{word()}.html", lambda: f"{pick(upper, rng.randint(3, 9))}_{pick(upper, rng.randint(4, 9))}",
    ]
    plain = [
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: digits(16), lambda: f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(2)}",
        lambda: f"v{digits(1)}.{digits(2)}.{digits(2)}-beta", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{word()}/{word()}/{digits(3)}.html",
        lambda: f"{word()}.{digits(2)}", lambda: f"mail{digits(1)}.{word()}.com", lambda: f"{word()}_{word()}_{digits(2)}", lambda: digits(9),
        lambda: f"{word()}{digits(2)}{word()}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"ISBN-{digits(13)}", lambda: f"{pick(upper, 2)}{digits(20)}",
        lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: f"{pick(upper, 3)}-{digits(5)}-{pick(upper, 2)}",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}", lambda: f"{word()}-{digits(1)}.{digits(2)}.{digits(1)}.tar.gz", lambda: f"/usr/{word()}/{word()}{digits(1)}/{word()}",
    ]
    leads = ["password", "token", "secret", "api_key", "bearer", "authorization", "key", "credential", "pwd", "access"]
    joints = [":", "=", "", " is", " =", " :", " was", " for the"]

    def lead() -> str:
        """A leading word, what joins it to what follows, and at times words between."""
        between = " " + " ".join(word() for _ in range(rng.randint(1, 2))) if rng.random() < 0.2 else ""
        name = rng.choice(leads)
        return (name.upper() if rng.random() < 0.15 else cap(name) if rng.random() < 0.2 else name) + between + rng.choice(joints)

    def closed(part: str, marked: bool) -> list[tuple[str, bool, str]]:
        """A part with what follows it: a blank, a new line or a mark right behind it."""
        mark = rng.choice((",", ".", ";", ")")) if rng.random() < 0.25 else ""
        gap = rng.choice((" ", " ", "\n"))
        return [(part, marked, ""), (mark, False, gap)] if mark else [(part, marked, gap)]

    for _ in range(lines):
        parts: list[tuple[str, bool, str]] = [(word(), False, " ") for _ in range(rng.randint(0, 6))]
        quote = rng.choice(("", "", "", '"', "'"))
        tight = rng.choice(("", " "))
        kind = rng.random()
        if kind < 0.04:
            # A block of lines is one secret.
            parts.append((f"-----BEGIN {rng.choice(('', 'RSA ', 'EC '))}PRIVATE KEY-----", False, "\n"))
            body = "\n".join([*(pick(mixed + "+/", 64) for _ in range(rng.randint(2, 5))), pick(mixed + "+/", rng.randint(12, 63))])
            parts += [(body, True, "\n"), ("-----END PRIVATE KEY-----", False, " ")]
        elif kind < 0.5:
            if rng.random() < 0.6:
                parts.append((lead(), False, tight if quote else " "))
            for _ in range(1 + (rng.random() < 0.2)):
                if quote:
                    parts += [(quote, False, tight), (rng.choice(secrets)(), True, tight), *closed(quote, False)]
                else:
                    parts += closed(rng.choice(secrets)(), True)
        elif kind < 0.75:
            if rng.random() < 0.2:
                parts.append((lead(), False, " "))
            for _ in range(rng.randint(1, 2)):
                parts += closed(rng.choice(plain)(), False)
        else:
            if rng.random() < 0.3:
                parts.append((lead(), False, " "))
            for _ in range(rng.randint(1, 3)):
                parts += closed(rng.choice(plain_words)(), False)
        parts += [(word(), False, " ") for _ in range(rng.randint(0, 6))]
        text, spans = "", []
        for part, marked, gap in parts:
            if marked:
                spans.append((len(text), len(text) + len(part)))
            text += part + gap
        yield text.rstrip(" "), spans


@lru_cache(maxsize=1)
def trained_field() -> Field:
    seen = []
    for text, secrets in _training_lines():
        for spans, names in _chains(text):
            of = [next((k for k, (c, d) in enumerate(secrets) if a < d and c < b), None) for a, b in spans]
            # A token of the same secret as the one before is inside; a further secret begins anew.
            seen.append((names, [0 if x is None else 2 if k and of[k - 1] == x else 1 for k, x in enumerate(of)]))
    field = Field(names for chain, _ in seen for names in chain)
    examples = [([field.features(names) for names in chain], labels) for chain, labels in seen]
    order = random.Random(1)
    for t in range(_ROUNDS):
        order.shuffle(examples)
        for features, labels in examples:
            field.learn(features, labels, _RATE / (1 + t))
    return field


def find_spans(text: str | None, emit: Field) -> list[tuple[str, int, int]]:
    """Base spans, and the field's spans that touch none of them, by start, then kind."""
    text = text or ""
    base = base_spans(text)
    extra = []
    for spans, labels in emit.label(text):
        for (a, b), label in zip(spans, labels, strict=True):
            if label == 2:
                extra[-1] = ("crf", extra[-1][1], b)
            elif label == 1:
                extra.append(("crf", a, b))
    if base and extra:
        edges = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in edges], list(accumulate((b for _, b in edges), max))
        touched = lambda a, b: (i := bisect_left(starts, b)) > 0 and reach[i - 1] > a
        extra = [s for s in extra if not touched(s[1], s[2])]
    return sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))


def _detected(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t.as_py(), field)] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for every row.

    A null text counts as empty and has no spans; a null id stays null; repeated rows
    each get their row; other columns are ignored; an empty table gives no rows.
    """
    field = trained_field()
    return narrow_input(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        lambda it: _detected(it, field), f"doc_id long, spans {SPANS}"
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans and a list of all spans, per row of ``detect``."""
    as_text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of_kind = lambda *kinds: lambda s: s["kind"].isin(*kinds)
    base = F.filter("spans", of_kind(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, as_text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", as_text), ",").alias("spans"),
    )
