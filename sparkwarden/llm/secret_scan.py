"""Secret scans: candidates by their characters, their form or a key word before them, and a random forest that removes false positives.

Candidates are runs of token characters, values after key words, passwords in URLs, signed web tokens and armoured blocks. The forest
sees a candidate's length, its mix of characters and transitions between them, how much of it a dictionary covers, its form, whether
it looks like part of a path, and the words next to it. It is trained from labelled findings: rows (before, candidate,
after, is_secret), by default `labelled_findings`, which makes findings of known kinds; `findings_of` makes them from a table of
labelled texts. Training takes a random sample of at most `rows` of them (TRAIN_ROWS by default).
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm._arrays import chunks, text_bytes, tidy

#: Labelled findings that a forest is trained from, at most.
TRAIN_ROWS = 6000
TREES, TREE_DEPTH, SEED = 48, 9, 11
LEAST_RUN, LEAST_VALUE, CONTEXT = 16, 8, 40
MASK = "[SECRET]"

_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="]] = True
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "auth")
_VALUE = re.compile(rb"(?i)(?:" + b"|".join(k.encode() for k in KEY_WORDS) + rb")[\w-]{0,16}[\"']?\s{0,3}(?::|=>?)\s{0,3}[\"']?([^\s\"'<>,;]{8,})")
_KEY = re.compile(rb"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)[\w-]{0,16}[\"']?\s{0,3}(?::|=>?)?\s{0,3}[\"']?$")
_DIGEST = re.compile(rb"(?i)(?:sha-?\d*|md5|commit|checksum|digest|integrity|etag|rev(?:ision)?|uuid|guid|hash|blob|tree)[\w-]{0,8}[\"']?\s{0,3}[:=]?\s{0,3}[\"']?(?:sha\d+-)?$")
_SAMPLE = re.compile(rb"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|todo|<[a-z_ -]+>|\*\*\*")
#: A password between `://user:` and `@`, a signed web token (three parts, or two if unsigned), and an armoured block up to its end
#: mark, or without one as far as its lines of base64 go.
_LOGIN = re.compile(rb"://[^\s:/@\"'<>]{0,64}:([^\s/@\"'<>]{3,256})@[A-Za-z0-9\[_-]")
_SIGNED = re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?")
_ARMOUR = re.compile(rb"-----BEGIN [A-Z0-9 ]{1,48}-----(?:\s{1,4}[A-Za-z-]{1,24}: [^\n]{1,80})*(?:(?:\s|\\[nr]){0,6}[A-Za-z0-9+/=]{16,})*(?:(?:\s|\\[nr]){0,6}[A-Za-z0-9+/=]{1,15})?(?:(?:\s|\\[nr]){0,6}-----END [A-Z0-9 ]{1,48}-----)?")
#: Beginnings of keys that providers document.
PROVIDERS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "xapp-", "npm_", "pypi-", "hf_", "dop_v1_", "shpat_", "ya29")
_PROVIDER = re.compile("|".join(map(re.escape, PROVIDERS)).encode())
_LOGIN_BEFORE = re.compile(rb"://[^\s:/@\"'<>]*:$")
_BLANK = re.compile(rb"(?i)[$<%{\[(*]*(?:your[_-]?)?(?:user)?(?:pass(?:word|wd)?|pwd|secret|token|key|x{3,}|\*+)[}>%\])*]*")
#: Common parts of names; what a candidate shares with them is no sign of a secret.
DICTIONARY = (
    "the and for with from that this not you are was have has get set put add new old all any one two key val value name path file user users data time date test tests main index list item items page pages "
    "config configuration default settings manager service server client request response handler controller factory builder context session module package import export public private static final class "
    "function method object string number array buffer stream reader writer parser format version build release master branch update create delete remove insert select order group table column database "
    "connection message error warning exception status state event action component container element button image icon style color background border margin padding width height content document window screen "
    "http https www com org net html json xml css script javascript python java node source resource asset lib bin usr local share home etc var tmp src doc docs"
).split()
_WORDS = sorted(set(w for w in DICTIONARY if len(w) >= 3), key=len, reverse=True)
_COVER = re.compile("|".join(map(re.escape, _WORDS)).encode())


def _pair_table() -> np.ndarray:
    """Log chances of letter pairs in names, from the dictionary."""
    counts = np.full((27, 27), 0.5)
    for w in _WORDS:
        codes = [0, *(ord(c) - 96 if "a" <= c <= "z" else 0 for c in w), 0]
        for a, b in zip(codes, codes[1:]):
            counts[a, b] += 1
    return np.log(counts / counts.sum(1, keepdims=True))


_PAIRS = _pair_table()
_KINDS = np.full(256, 3)
_KINDS[[*b"abcdefghijklmnopqrstuvwxyz"]], _KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]], _KINDS[[*b"0123456789"]] = 0, 1, 2
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)
FEATURES = ("length", "entropy", "lower", "upper", "digits", "other", "kind_changes", "distinct", "longest_same_kind", "letter_pairs", "dictionary", "hex", "slashes", "separators", "path_before", "path_after", "key_before", "digest_before", "assigned", "quoted", "sample", "url_before", "uuid", "login", "blank", "signed", "provider", "armour", "private", "encoded")


def features(before: bytes, word: bytes, after: bytes) -> list[float]:
    """The features of a candidate between the text before and after it."""
    b = np.frombuffer(word, np.uint8)
    n = len(b)
    count = np.bincount(b)
    p = count[count > 0] / n
    kind = _KINDS[b]
    change = kind[1:] != kind[:-1]
    share = np.bincount(kind, minlength=4) / n
    edges = np.flatnonzero(np.concatenate([[True], change, [True]]))
    letter = _LETTER[b]
    return [
        math.log2(n), float(-(p * np.log2(p)).sum()), *share.tolist(), float(change.mean()) if n > 1 else 0.0, len(p) / min(n, 64), float(np.diff(edges).max()) / n, float(_PAIRS[letter[:-1], letter[1:]].mean()) if n > 1 else 0.0,
        sum(map(len, _COVER.findall(word.lower()))) / n, float(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", word) is not None), word.count(b"/") / n * 10, (word.count(b"-") + word.count(b"_")) / n * 10,
        float(re.search(rb"[./\\:~]$", before) is not None), float(re.match(rb"\.\w|[\\/]", after) is not None), float(_KEY.search(before) is not None), float(_DIGEST.search(before) is not None),
        float(re.search(rb"[:=]\s*[\"']?$", before) is not None), float(before[-1:] in (b'"', b"'") and after[:1] == before[-1:]), float(_SAMPLE.search(before[-16:] + word) is not None), float(re.search(rb"https?://\S*$", before) is not None),
        float(re.fullmatch(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", word) is not None),
        float(after[:1] == b"@" and _LOGIN_BEFORE.search(before) is not None), float(_BLANK.fullmatch(word) is not None), float(_SIGNED.fullmatch(word) is not None), float(_PROVIDER.match(word) is not None),
        float(word.startswith(b"-----BEGIN ")), float(re.match(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY", word) is not None), float(re.search(rb"base64,\s?$", before) is not None),
    ]


def labelled_findings(n: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[bytes, bytes, bytes, int]]:
    """The candidates of n made-up pieces of text, with labels: whether they overlap what was planted there as a secret.

    Secrets are keys and passwords behind key words, passwords in URLs, signed tokens, private key blocks, providers' keys and bare
    base64; the rest are digests, ids, names, paths, numbers, placeholders, public blocks, embedded files and parts of URLs.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    run = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    between = lambda a, b: int(rng.integers(a, b))
    digits, hexa, letters = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    alnum, base, web = letters + digits, letters + digits + "+/", letters + digits + "-_"
    said = lambda: "".join(pick("bcdfghjklmnprstvwz") + pick(["a", "e", "i", "o", "u", "ai", "ea", "ou"]) for _ in range(between(1, 4))) + pick(["", "n", "r", "s", "t", "ck", "ng"])
    word = lambda: pick(_WORDS) if rng.random() < 0.6 else said()  # noqa: E731  some of them unknown to the dictionary
    words = lambda k, sep: sep.join(word() for _ in range(k))
    cased = lambda: pick([str, str, str.capitalize, str.upper])(word()) + pick(["", "", "", run(digits, between(1, 5))])
    noise = lambda: words(between(0, 6), " ")
    password = lambda: pick([run(alnum + "!#$%&*-_", between(8, 24)), pick(_WORDS).capitalize() + run(digits, between(2, 5)) + pick("!?#*"), words(2, pick("-._")) + run(digits, between(2, 4))])
    lines = lambda: pick(["\n", "\n", " ", "\\n"]).join(run(base, 64) for _ in range(between(2, 26)))

    def block(kind: str) -> str:
        gap = pick(["\n", "\n", " ", "\\n"])
        return f"-----BEGIN {kind}-----{gap}{lines()}{gap}{run(base, between(4, 60))}{pick(['', '=', '=='])}{gap}-----END {kind}-----"

    def secret() -> tuple[str, str, str]:
        kind, before, after = between(0, 10), f"{noise()} ", f" {noise()}"
        if kind == 0:
            return f"{noise()} {pick(['postgres', 'postgresql', 'mysql', 'mongodb+srv', 'redis', 'amqp', 'https', 'ftp'])}://{pick([pick(_WORDS), 'root', 'admin', ''])}:", password(), f"@{pick(_WORDS)}.{pick(['internal', 'example', 'net', 'local'])}{pick([':5432', ''])}/{pick(_WORDS)}{after}"
        if kind == 1:
            return before, f"eyJ{run(web, between(15, 60))}.eyJ{run(web, between(20, 200))}.{run(web, pick([43, 86, 342]))}", after
        if kind == 2:
            return before, block(pick(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY"])), after
        if kind == 3:
            start = pick(PROVIDERS)
            return before, start + (run(letters[:26] + digits, 16) if start in ("AKIA", "ASIA") else run(alnum, between(20, 44))), after
        if kind == 4:
            return before, run(base, pick([40, 40, 40, 44, 64])) + pick(["", "", "=", "=="]), after
        quote, sep = pick(['"', "'", ""]), pick([" = ", ": ", "=", ":", " "])
        name = pick(KEY_WORDS) + pick(["", "", "_id", "Key"])
        name = pick([name, name, name.upper(), "client_" + name, "db." + name, "Bearer"])
        value = pick([lambda: run(hexa, pick([32, 40, 48, 64])), lambda: run(hexa, pick([32, 40, 64])).upper(), lambda: run(alnum, between(20, 65)), lambda: run(base, between(6, 16) * 4) + pick(["", "=", "=="]), password])()
        return f"{noise()} {name}{sep}{quote}", value, quote + after

    def other() -> tuple[str, str, str]:
        kind, before, after = between(0, 14), f"{noise()} ", f" {noise()}"
        quote, sep = pick(['"', "'", ""]), pick([" = ", ": ", "=", ":", " "])
        if kind == 0:
            return f"{noise()} {pick(['sha1', 'sha256', 'md5', 'commit', 'checksum', 'digest', 'integrity', 'etag', 'revision'])}{sep}{quote}", run(hexa, pick([32, 40, 64])), quote + after
        if kind == 1:
            return f"{noise()} {pick(['id', 'uuid', 'guid', 'ref', 'node'])}{sep}{quote}", "-".join(run(hexa, k) for k in (8, 4, 4, 4, 12)), quote + after
        if kind == 2:
            return before, words(between(2, 6), pick(["_", "-", ""])) + pick(["", "", run(digits, between(1, 5))]), after
        if kind == 3:
            return pick([" ", " .", " https://www.", " ~", f"{word()}="]) + noise() * (rng.random() < 0.2), pick(["", "/"]) + "/".join(cased() for _ in range(between(2, 8))), pick([".html ", ".py ", ".tar.gz ", "/ ", " "]) + noise()
        if kind == 4:
            return before, run(digits, between(12, 24)), after
        if kind == 5:
            return f"{noise()} {pick(KEY_WORDS)}{sep}{quote}", pick(["your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "changeme_changeme", "EXAMPLEKEYEXAMPLE", "********************", "insert-token-here"]), quote + after
        if kind == 6:
            return before, "".join(word().capitalize() for _ in range(between(3, 7))) + pick(["", "", run(digits, between(1, 4))]), after
        if kind == 7:
            return f"{noise()} {pick(KEY_WORDS)}{sep}", words(between(1, 4), pick(["_", ".", ""])), after
        if kind == 8:
            return before, block(pick(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "X509 CRL"])), after
        if kind == 9:
            return f"{noise()} {pick(['data:image/png;base64,', 'data:font/woff2;base64,', 'integrity=' + quote + 'sha512-', 'integrity=' + quote + 'sha256-'])}", run(base, between(11, 50) * 4) + pick(["", "=", "=="]), quote + after
        if kind == 10:
            return f"{noise()} https://{pick(_WORDS)}.com/{pick(['watch?v=', 'd/', 'id=', 'p/'])}", run(web, between(16, 45)), pick(["/edit ", " ", "&x=1 "]) + after
        if kind == 11:
            return f"{noise()} {pick(['postgres', 'mysql', 'redis', 'https'])}://{pick(['user', 'username', pick(_WORDS)])}:", pick(["password", "pass", "${PASSWORD}", "<password>", "{password}", "PASSWORD", "secret", "****", "xxxx", "your_password"]), f"@{pick(['localhost', 'host'])}/db{after}"
        if kind == 12:
            return before, pick([run(hexa, pick([32, 40, 64])), "0x" + run(hexa, 40)]), after
        return before, pick([run("abcdefghijklmnopqrstuvwxyz", between(16, 40)) + run(digits, between(1, 3)), f"{pick(_WORDS)}-{between(1, 20)}.{between(0, 20)}.{between(0, 20)}-{words(2, '-')}", "-".join(pick(_WORDS) for _ in range(3)) + f"-20{between(10, 30)}-{between(10, 13)}-{between(10, 29)}"]), after

    out = []
    for _ in range(n):
        planted = rng.random() < 0.5
        before, value, after = (x.encode() for x in (secret if planted else other)())
        text = before + value + after
        for _, a, b in candidates(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0, 1):
            inside = planted and a < len(before) + len(value) and b > len(before)
            out.append((text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT], int(inside)))
    return out


class Forest:
    """A random forest of binary trees in flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = TREE_DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.feature, self.cut, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        self.depth = depth
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            self.roots.append(self._grow(x[rows], y[rows], depth, rng))
        self.feature, self.left, self.right, self.roots = (np.array(a, np.int64) for a in (self.feature, self.left, self.right, self.roots))
        self.cut, self.value = np.array(self.cut), np.array(self.value)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        k = len(self.feature)
        for a, v in ((self.feature, 0), (self.cut, np.inf), (self.left, k), (self.right, k), (self.value, float(y.mean()))):
            a.append(v)
        if depth == 0 or len(y) < 8 or y.min() == y.max():
            return k
        best = (1e-9, 0, 0.0)
        parent = y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))) + 1, replace=False):
            v = x[:, f]
            cuts = np.unique(np.sort(v)[(np.linspace(0.05, 0.95, 15) * (len(v) - 1)).astype(int)])
            under = v[:, None] <= cuts
            n = under.sum(0)
            ok = (n > 1) & (n < len(y) - 1)
            if not ok.any():
                continue
            a = (under * y[:, None]).sum(0) / np.maximum(n, 1)
            b = (y.sum() - a * n) / np.maximum(len(y) - n, 1)
            gain = np.where(ok, parent - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y), -1)
            g = int(gain.argmax())
            if gain[g] > best[0]:
                best = (float(gain[g]), int(f), float(cuts[g]))
        if best[0] <= 1e-9:
            return k
        under = x[:, best[1]] <= best[2]
        self.feature[k], self.cut[k] = best[1], best[2]
        self.left[k] = self._grow(x[under], y[under], depth - 1, rng)
        self.right[k] = self._grow(x[~under], y[~under], depth - 1, rng)
        return k

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean share of secrets in the leaves that each row reaches."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.value[at].mean(1)


def train(findings: list[tuple[bytes, bytes, bytes, int]] | None = None, rows: int = TRAIN_ROWS, seed: int = SEED) -> Forest:
    """A forest from labelled findings (before, candidate, after, is_secret), of which at most `rows` are drawn at random."""
    findings = labelled_findings(rows, seed) if findings is None else findings
    if not findings:
        raise ValueError("no labelled findings to learn from")
    if len(findings) > rows:
        findings = [findings[k] for k in np.sort(np.random.default_rng(seed).choice(len(findings), rows, replace=False))]
    return Forest(np.array([features(a, b, c) for a, b, c, _ in findings]), np.array([y for *_, y in findings], float), seed=seed)


@functools.lru_cache(maxsize=1)
def default_forest() -> Forest:
    """The forest from `labelled_findings`, made once a driver."""
    return train()


def findings_of(df: DataFrame, text_col: str = "text", secrets_col: str = "secret_values", rows: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[bytes, bytes, bytes, int]]:
    """Labelled findings of texts whose true secrets (array of strings) are known: each candidate that is one of them, or lies in
    one or around one, counts as a secret. At most about `rows` candidates are drawn, evenly from the whole table.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            known = [[s.encode() for s in x or [] if s] for x in batch.column("known").to_pylist()]
            for i, j in chunks(offsets):
                out = []
                for r, a, b in candidates(data, offsets, i, j):
                    at = int(offsets[r])
                    cut = lambda x, y: data[at + max(0, x) : min(at + y, int(offsets[r + 1]))].tobytes()  # noqa: E731, B023
                    word = cut(a, b)
                    out.append((cut(a - CONTEXT, a), word, cut(b, b + CONTEXT), any(word in s or s in word for s in known[r])))
                if out:
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("before", "word", "after", "is_secret"), zip(*out), (pa.binary(), pa.binary(), pa.binary(), pa.bool_()))})

    found = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{secrets_col}`").alias("known")).mapInArrow(run, "before binary, word binary, after binary, is_secret boolean")
    drawn = found.orderBy(F.xxhash64("before", "word", "after", F.lit(seed))).limit(rows).collect()  # at most `rows`
    return [(bytes(r.before), bytes(r.word), bytes(r.after), int(r.is_secret)) for r in drawn]


def candidates(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """(row, begin, end) in bytes of the row: runs of token characters with a digit or mixed case, values after key words, passwords in
    URLs, signed tokens and armoured blocks.

    A value and the runs that it overlaps are all candidates; `united` makes one span of them. Runs within an armoured block are none.
    """
    raw = data[offsets[i] : offsets[j]]
    rows = offsets[i : j + 1] - offsets[i]
    found: set[tuple[int, int, int]] = set()
    if not len(raw):
        return []
    token = np.zeros(len(raw) + 2, np.int8)
    token[1:-1] = _TOKEN[raw]
    edge = np.diff(token)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a run that spans rows is cut at their border
    inner = rows[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    inner = inner[(token[inner] == 1) & (token[inner + 1] == 1)]
    starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
    text = raw.tobytes()
    for a, b in zip(starts[ends - starts >= LEAST_RUN].tolist(), ends[ends - starts >= LEAST_RUN].tolist()):
        a += text[a:b].rstrip(b"=").rfind(b"=") + 1  # what a name and a sign of equality stand before
        word = text[a:b]
        if len(word) >= LEAST_RUN and (re.search(rb"\d", word) or re.search(rb"[a-z][A-Z]|[A-Z]{2}[a-z]", word)):
            row = int(np.searchsorted(rows, a, "right")) - 1
            found.add((i + row, a - int(rows[row]), b - int(rows[row])))
    for row in range(j - i):
        own = text[rows[row] : rows[row + 1]]
        low = own.lower()
        if any(k.encode() in low for k in KEY_WORDS):
            for m in _VALUE.finditer(own):
                found.add((i + row, *m.span(1)))
        if b"://" in own and b"@" in own:
            found.update((i + row, *m.span(1)) for m in _LOGIN.finditer(own))
        if b"eyJ" in own:
            found.update((i + row, *m.span()) for m in _SIGNED.finditer(own))
        if b"-----BEGIN " in own:
            blocks = [m.span() for m in _ARMOUR.finditer(own)]
            begins = [a for a, _ in blocks]
            within = lambda a, b: (k := bisect.bisect_right(begins, a)) and b <= blocks[k - 1][1]  # noqa: E731, B023
            found = {f for f in found if f[0] != i + row or not within(*f[1:])} | {(i + row, a, b) for a, b in blocks}
    return sorted(found)


def united(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Spans (begin, end, score) in order, those that overlap as one with the largest score."""
    out: list[tuple[int, int, float]] = []
    for a, b, score in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(score, out[-1][2]))
        else:
            out.append((a, b, score))
    return out


SCAN = "n_candidates long, secrets array<struct<begin:int,end:int,score:double>>, redacted string"


def _scan(forest: Forest, least: float, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_sw_text")
            data, offsets = text_bytes(column)
            number, secrets, changed = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], {}
            for i, j in chunks(offsets):
                found = candidates(data, offsets, i, j)
                texts = {r: data[offsets[r] : offsets[r + 1]].tobytes() for r in {r for r, _, _ in found}}
                x = np.array([features(texts[r][max(0, a - CONTEXT) : a], texts[r][a:b], texts[r][b : b + CONTEXT]) for r, a, b in found]).reshape(-1, len(FEATURES))
                places: dict[int, list[tuple[int, int, float]]] = {}
                for (r, a, b), score in zip(found, forest.score(x).tolist() if len(x) else []):
                    places.setdefault(r, []).append((a, b, score))
                for r, own in texts.items():
                    number[r] = len(united(places[r]))
                    secrets[r] = united([p for p in places[r] if p[2] >= least])
                    if secrets[r]:
                        parts, at, spans = [], 0, []
                        points = np.concatenate([[0], np.cumsum((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)])  # code points before each byte
                        for a, b, score in secrets[r]:
                            parts += [own[at:a], MASK.encode()]
                            spans.append({"begin": int(points[a]), "end": int(points[b]), "score": score})
                            at = b
                        changed[r] = b"".join([*parts, own[at:]]).decode()
                        secrets[r] = spans
            texts_out = column.to_pylist() if changed else None
            if texts_out:
                for r, t in changed.items():
                    texts_out[r] = t
            rest = {c: batch.column(c) for c in columns}
            yield pa.RecordBatch.from_pydict(rest | {"n_candidates": pa.array(number), "secrets": pa.array(secrets, kind), "redacted": pa.array(texts_out, pa.string()) if texts_out else column})

    return run


def scan(df: DataFrame, text_col: str = "text", forest: Forest | None = None, least: float = 0.5) -> DataFrame:
    """All columns of df but `text_col`, with n_candidates, secrets (begin, end in code points, score) and redacted.

    A candidate is a secret if the forest gives it `least` or more; candidates that overlap count as one, and secrets that do are
    one, from the first's begin to the last's end. In `redacted` each secret is replaced by [SECRET]. Null text
    has no candidates and stays null, repeated rows are scanned as often as they occur, an empty table gives an empty result.
    """
    columns = [c for c in df.columns if c != text_col]
    renamed, found = _scanned(df, columns, text_col, forest, least)
    return found.select(*[F.col(renamed[c]).alias(c) for c in columns], "n_candidates", "secrets", "redacted")


def _scanned(df: DataFrame, columns: list[str], text_col: str, forest: Forest | None, least: float) -> tuple[dict[str, str], DataFrame]:
    """`columns` of df under names of their own (also returned), n_candidates, secrets and redacted; so no name of df can clash."""
    renamed = {c: f"_sw_{k}" for k, c in enumerate(columns)}
    kinds = "".join(f"{renamed[c]} {df.schema[c].dataType.simpleString()}, " for c in columns)
    rows = df.select(*[F.col(f"`{c}`").alias(renamed[c]) for c in columns], F.col(f"`{text_col}`").alias("_sw_text"))
    return renamed, rows.mapInArrow(_scan(forest or default_forest(), least, list(renamed.values())), kinds + SCAN)


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets, redacted_sha256 of each row."""
    found = scan(df.select(F.col(id_col), F.col(text_col)), text_col)
    return found.select(id_col, "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets", F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with its texts redacted, and `length_col` (code points) brought up to date where a text has changed."""
    own, found = _scanned(df, df.columns, text_col, None, 0.5)
    changed = F.size("secrets") > 0
    new = {text_col: F.when(changed, F.col("redacted")).otherwise(F.col(own[text_col]))}
    if length_col in df.columns:
        new[length_col] = F.when(changed, F.char_length("redacted").cast(df.schema[length_col].dataType)).otherwise(F.col(own[length_col]))
    return found.select(*[new.get(c, F.col(own[c])).alias(c) for c in df.columns])
