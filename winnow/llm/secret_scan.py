"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens.

Candidate tokens are the ones with a digit, with twenty or more characters, with a secret word in
them, and whatever stands behind a secret word; candidates close to each other form a chain.  Each
token is described by its shape and length, the signs around it, the word before and the word
after it, the candidate before it, and two features of the file.  The field has the states outside,
begin and inside, is fitted by forward-backward and decoded by Viterbi.

It is fitted on a bounded sample (``FIT_ROWS`` documents, ``FIT_PIECES`` pieces of chains with and as
many without a secret).  Marks come from the patterns and from secrets that are made up and set
between the words of the sampled documents: many key words, signs and value shapes, and beside them
sentences that only speak of passwords, which stay outside.  So the field also marks values that no
pattern knows.

A pattern match is always a span; a decoded secret that overlaps none is added with kind crf.

Defined results: null and empty texts have no spans; whole texts are read, positions count code
points; repeated rows give repeated results; without any mark in the sample the field marks
nothing; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import bounded_sample, map_slices, settle, table
from winnow.llm.registry import query

#: Most documents the field is fitted on, and pieces of their chains with, and without a secret.
FIT_ROWS = 4000
FIT_PIECES = 2500
#: Tokens after which a chain is cut for fitting; decoding always takes whole chains.
FIT_TOKENS = 64
#: Characters between two candidates of one chain at most.
CHAIN_GAP = 40

KINDS = ("assign", "access", "hex", "crf")
# fixed values: the base patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

_SIGNS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_MORE = ("bearer", "authorization", "credential", "private_key", "passphrase")
_ENDS = ("_key", "-key", "_pwd", "_auth", "_pass")
_WORD = "[A-Za-z0-9+/_.-]"
_CANDIDATE = re.compile(rf"(?<!{_WORD})(?:{_WORD}*?[0-9]{_WORD}*|{_WORD}{{20,}})", re.A)
# from the start of a run only: a long run without a sign is then read once, not once a position
_NAMED = re.compile(rf"(?<!{_WORD}){_WORD}*?(?:{'|'.join((*_SIGNS, *_MORE, *_ENDS))}){_WORD}*",
                    re.A | re.I)
#: What a secret word names: the next token, behind signs and quotes.
_VALUE = re.compile(rf"""["']?\s{{0,3}}(?:[:=]|=>|:=)?\s{{0,3}}["']?({_WORD}+)""", re.A)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words are features by their hash, so the number of weights is bounded.
WORD_HASHES = 1024
#: Characters looked at for the words around a token.
_REACH = 24
_SET_BY = re.compile(r"""["']?\s*[:=]\s*["']?\s*\Z""")
_SHAPES = (
    ("number", re.compile(r"[0-9.+/-]+\Z", re.A)), ("hex", re.compile(r"[0-9a-f]{12,}\Z", re.A)),
    ("upper", re.compile(r"[A-Z0-9]{12,}\Z", re.A)),
    ("mixed", re.compile(r"(?=.*[0-9])(?=.*[A-Za-z]).{12,}\Z", re.A | re.S)),
    ("letters", re.compile(r"[A-Za-z]{20,}\Z", re.A)),
    ("lower", re.compile(r"[a-z]{6,}\Z", re.A)), ("word", re.compile(r"[A-Za-z]+\Z", re.A)))


def base_spans(text: str, candidates: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, sorted.

    Access keys and hex runs consist of token characters only and have a digit or over twenty
    of them, so they lie inside candidates.
    """
    out = []
    low = text.lower()
    if any(s in low for s in _SIGNS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for a, b in candidates:
        if b - a < 20:
            continue
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, a, b)
                if m.end() - m.start() >= 20]
        if b - a >= 24:
            out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b)
                    if m.end() - m.start() >= 24]
    return sorted(out)


def candidate_tokens(text: str) -> list[tuple[int, int]]:
    found = [m.span() for m in _CANDIDATE.finditer(text)]
    low = text.lower()
    if any(s in low for s in (*_SIGNS, *_MORE, *_ENDS)):
        spans = set(found)
        for m in _NAMED.finditer(text):
            spans.add(m.span())
            value = _VALUE.match(text, m.end())
            if value:
                spans.add(value.span(1))
        found = _apart(sorted(spans, key=lambda s: (s[0], -s[1])))
    return found


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans that overlap the one that begins first, then the longer one."""
    out, upto = [], -1
    for a, b in spans:
        if a >= upto:
            out.append((a, b))
            upto = b
    return out


def _word(words: list[str], at: int, side: str) -> str:
    if not words:
        return f"{side}-none"
    return f"{side}{zlib.crc32(words[at].lower().encode()) % WORD_HASHES}"


def _shape(token: str) -> str:
    return next((name for name, p in _SHAPES if p.match(token)), "short")


def _family(token: str) -> str:
    """Coarser than the shape, so that a shape never seen in a secret is not taken for a word."""
    digit, letter = any(c.isdigit() for c in token), any(c.isalpha() for c in token)
    return "f-both" if digit and letter else "f-digits" if digit else "f-letters"


def chains(text: str, candidates: list[tuple[int, int]]
           ) -> list[tuple[list[tuple[int, int]], tuple[tuple[str, ...], ...]]]:
    """Candidates close to each other, with the features of each."""
    if not candidates:
        return []
    low = text.lower()
    named = "named" if any(s in low for s in _SIGNS) else "plain"
    dense = "dense" if len(candidates) * 50 > len(text) else "thin"
    out, spans, feats = [], [], []
    last_end, last_key = -CHAIN_GAP - 1, False
    for a, b in candidates:
        if a - last_end > CHAIN_GAP and spans:
            out.append((spans, tuple(feats)))
            spans, feats, last_key = [], [], False
        token = text[a:b]
        key = bool(_NAMED.match(token))
        before = text[max(0, a - 12):a]
        quoted = before[-1:] in ('"', "'") and text[b:b + 1] == before[-1:]
        size = b - a
        feats.append((
            "key" if key else _shape(token), "f-key" if key else _family(token),
            "len" + str(0 if size < 8 else 1 if size < 16 else 2 if size < 24 else 3
                        if size < 36 else 4),
            "set" if _SET_BY.search(before) else "said",
            "after-key" if last_key else "after-none",
            "quoted" if quoted else "bare",
            "next-set" if text[b:b + 3].lstrip(" \"'")[:1] in ("=", ":") else "next-none",
            named, dense, _word(_LETTERS.findall(text, max(0, a - _REACH), a), -1, "w"),
            _word(_LETTERS.findall(text, b, b + _REACH), 0, "v")))
        spans.append((a, b))
        last_end, last_key = b, key
    out.append((spans, tuple(feats)))
    return out


class ChainField:
    """Weights of the features and transitions of the states outside, begin, inside."""

    N = 3

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self.first = np.array([0.0, 0.0, -1e9])  # nothing starts inside
        self._seen: dict[tuple, tuple[int, ...]] = {}

    def viterbi(self, feats: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
        known = self._seen.get(feats)
        if known is not None:
            return known
        e = [sum((self.weights[self.index[f]] for f in fs if f in self.index), np.zeros(3))
             for fs in feats]
        best, back = e[0] + self.first, []
        for x in e[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + x
        state = int(best.argmax())
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        result = tuple(reversed(out))
        if len(self._seen) < 50_000:
            self._seen[feats] = result
        return result


def fit_field(samples: Counter, steps: int = 150, rate: float = 0.1,
              decay: float = 1e-3) -> ChainField:
    """Field from counted (features, states) chains: log likelihood by forward-backward, Adam."""
    index = {f: i for i, f in enumerate(sorted({f for fs, _ in samples for x in fs for f in x}))}
    weights, moves = np.zeros((len(index), 3)), np.zeros((3, 3))
    ban = np.zeros((3, 3))
    ban[0, 2] = -1e9  # inside needs a begin before it
    field = ChainField(index, weights, moves + ban)
    if not any(1 in states for _, states in samples):
        if index:
            weights[:, 0] = 1.0
        return field
    groups = defaultdict(list)
    for (fs, states), n in samples.items():
        groups[len(states)].append(([[index[f] for f in x] for x in fs], states, n))
    packed = [(np.array([g[0] for g in gs]), np.array([g[1] for g in gs]),
               np.array([g[2] for g in gs], float)) for gs in groups.values()]
    total = sum(n.sum() for _, _, n in packed)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, moves)]
    for t in range(1, steps + 1):
        gw, gm = decay * weights, decay * moves
        for feats, ys, n in packed:
            e = weights[feats].sum(axis=2)
            m = moves + ban
            length = e.shape[1]
            fwd, bwd = np.empty_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0] + field.first
            for i in range(1, length):
                fwd[:, i] = _lse(fwd[:, i - 1][:, :, None] + m, 1) + e[:, i]
            for i in range(length - 2, -1, -1):
                bwd[:, i] = _lse(m + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            z = _lse(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - z[:, None, None])
            p[np.arange(len(ys))[:, None], np.arange(length), ys] -= 1.0
            p *= (n / total)[:, None, None]
            for y in range(3):
                gw[:, y] += np.bincount(feats.ravel(), np.broadcast_to(
                    p[:, :, None, y], feats.shape).ravel(), len(gw))
            for i in range(1, length):
                pair = np.exp(fwd[:, i - 1][:, :, None] + m
                              + (e[:, i] + bwd[:, i] - z[:, None])[:, None, :])
                gm += np.einsum("s,sab->ab", n / total, pair)
                np.add.at(gm, (ys[:, i - 1], ys[:, i]), -n / total)
        for value, grad, (a, b) in zip((weights, moves), (gw, gm), state):
            a += 0.1 * (grad - a)
            b += 0.001 * (grad * grad - b)
            value -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    field.moves = moves + ban
    return field


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def marked_chains(text: str, marks: list[tuple[int, int]] | None = None
                  ) -> list[tuple[tuple, tuple[int, ...]]]:
    """Chains of a text with their states; marked are (start, end) and by default what the
    patterns match."""
    candidates = candidate_tokens(text)
    if marks is None:
        marks = [(a, b) for a, _, b in base_spans(text, candidates)]
    out = []
    for tokens, feats in chains(text, candidates):
        states, last = [], None
        for (a, b), fs in zip(tokens, feats):
            hit = next((s for s in marks if s[0] < b and a < s[1] and fs[0] != "key"), None)
            states.append(0 if hit is None else 2 if hit is last else 1)
            last = hit
        out.append((feats, tuple(states)))
    return out


# what made-up secrets are composed of
_MADE_KEYS = ("password", "passwd", "secret", "token", "api_key", "client_key", "passphrase",
              "private_key", "access_token", "db_pwd", "signing_key", "credential", "user_pass")
_MADE_SET = (" = ", "=", ": ", ":", " := ", '": "')
_MADE_SAID = ("authorization: bearer {}", "Authorization: Bearer {}", "bearer {}",
              "use the passphrase {}", "the password is {}", "log in with token {}")
_HARMLESS = ("the password is required", "a token of thanks", "secret to success", "token count: 12",
             "forgot your password?", "an open secret among 30 people", "the api_key was removed",
             "credential checks in 2019", "passphrase too short", "key figures: 100 and 250",
             "password: required", "secret: none", "bearer of good news", "order 4711 of 12.05.2020")


def made_value(r: random.Random, kinds: tuple[str, ...]) -> str:
    kind = r.choice(kinds)
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == "hex":
        return "".join(r.choice("0123456789abcdef") for _ in range(r.choice((24, 32, 40, 64))))
    if kind == "upper":
        return "".join(r.choice(letters.upper() + "0123456789") for _ in range(r.randint(16, 32)))
    if kind == "words":
        return "".join(r.choice(("correct", "horse", "maple", "river", "stone", "falcon", "winter"))
                       for _ in range(r.randint(2, 3)))
    if kind == "lower":
        return "".join(r.choice(letters) for _ in range(r.randint(8, 24)))
    return "".join(r.choice(letters + letters.upper() + "0123456789") for _ in range(
        r.randint(8, 40)))


VALUE_KINDS = ("hex", "upper", "words", "lower", "mixed")


def with_made_secrets(text: str, seed: int, kinds: tuple[str, ...] = VALUE_KINDS
                      ) -> tuple[str, list[tuple[int, int]]]:
    """The text with two made-up secrets and two harmless sentences between its words, and where
    the values of the secrets stand."""
    r = random.Random(seed)
    gaps = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
    put = []
    for _ in range(2):
        value = made_value(r, kinds)
        if r.random() < 0.6:
            sign, quote = r.choice(_MADE_SET), r.choice(("", "", '"', "'"))
            quote = "" if '"' in sign else quote
            head = f"{r.choice(_MADE_KEYS)}{sign}{quote}"
            tail = '"' if '"' in sign else quote
        else:
            head, tail = r.choice(_MADE_SAID).split("{}")
        put.append((r.choice(gaps), head, value, tail))
    put += [(r.choice(gaps), r.choice(_HARMLESS), "", "") for _ in range(2)]
    out, marks, at, size = [], [], 0, 0
    for gap, head, value, tail in sorted(put):
        piece = text[at:gap] + " " + head
        out += [piece, value, tail]
        size += len(piece)
        if value:
            marks.append((size, size + len(value)))
        size += len(value) + len(tail)
        at = gap
    return "".join([*out, text[at:]]), marks


def training_chains(text: str, kinds: tuple[str, ...] = VALUE_KINDS, patterns: bool = True
                    ) -> list[tuple[tuple, tuple[int, ...]]]:
    """Marked chains of a text as it is, and of the text with made-up secrets."""
    made, marks = with_made_secrets(text, zlib.crc32(text.encode()), kinds)
    own = base_spans(text, candidate_tokens(text)) if patterns else []
    all_ = [*marks, *((a, b) for a, _, b in base_spans(made, candidate_tokens(made)))]
    return [*marked_chains(text, [(a, b) for a, _, b in own]),
            *marked_chains(made, all_ if patterns else marks)]


def fit_pieces(feats: tuple, states: tuple[int, ...], most: int = FIT_TOKENS
               ) -> list[tuple[tuple, tuple[int, ...]]]:
    """A marked chain cut after ``most`` tokens, never inside a secret."""
    out, at = [], 0
    for i in range(len(states)):
        if i - at >= most and states[i] != 2:
            out.append((feats[at:i], states[at:i]))
            at = i
    return [*out, (feats[at:], states[at:])]


def fit_on(docs: DataFrame, rows: int = FIT_ROWS, pieces: int = FIT_PIECES,
           kinds: tuple[str, ...] = VALUE_KINDS, patterns: bool = True) -> ChainField:
    """Field from at most ``rows`` documents and ``pieces`` distinct pieces of chains with a secret,
    and as many without; pieces are counted before they travel and have a bounded length, so the
    fit does not grow with a long text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter(p for t in batch.column(0).to_pylist()
                       for c in training_chains(t or "", kinds, patterns) for p in fit_pieces(*c))
        keys = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(["\n".join(" ".join(x) for x in f) for f, _ in keys], pa.string()),
             pa.array(["".join(map(str, s)) for _, s in keys], pa.string()),
             pa.array([seen[k] for k in keys], pa.int64())], names=["feats", "states", "n"])

    picked = bounded_sample(docs.select("doc_id", "text"), F.col("doc_id"), rows)
    counted = settle(map_slices(picked.select("text"), work, "feats string, states string, n bigint")
                     .groupBy("feats", "states").agg(F.sum("n").alias("n")))
    got = []
    for marked in (True, False):
        part = counted.filter(F.col("states").contains("1") == F.lit(marked))
        got += part.orderBy(F.xxhash64("feats"), "feats", "states").limit(pieces).collect()
    return fit_field(Counter({
        (tuple(tuple(x.split(" ")) for x in r["feats"].split("\n")),
         tuple(map(int, r["states"]))): r["n"]
        for r in sorted(got, key=lambda r: (r["feats"], r["states"]))}))


def spans_of(text: str, field: ChainField) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets of a text, by start and kind."""
    candidates = candidate_tokens(text)
    spans = base_spans(text, candidates)
    if not candidates:
        return spans
    added = []
    for tokens, feats in chains(text, candidates):
        open_ = None
        for (a, b), s in zip(tokens, field.viterbi(feats)):
            if s == 1:
                open_ = [a, b]
                added.append(open_)
            elif s == 2 and open_:
                open_[1] = b
            else:
                open_ = None
    new = [(a, 3, b) for a, b in added if not any(s[0] < b and a < s[2] for s in spans)]
    return sorted(spans + new)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, field: ChainField, text: str = "text",
         out: str = "spans") -> DataFrame:
    """All columns of ``docs`` and the secret spans of its whole texts."""
    if out in docs.columns:
        raise ValueError(f"column {out} is there already")
    where, names = docs.columns.index(text), [*docs.columns, out]
    schema = T.StructType([*docs.schema.fields,
                           *T._parse_datatype_string(f"{out} {_SPANS}").fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                               ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t or "", field)]
                for t in batch.column(where).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=names)

    return map_slices(docs, work, schema)


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit_on(docs)).select("doc_id", "spans")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(F.encode(joined(base), "UTF-8"), 256)
        .alias("base_sha256"), joined(F.col("spans")).alias("spans"))
