"""Secret scans: a linear-chain conditional random field tags words as the begin or inside of a secret, or outside."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import columns
from codeloom.llm.sampling import among_lowest

OUT, BEGIN, IN = 0, 1, 2
MASK = "<secret>"
_CORE = re.compile(r"[A-Za-z0-9+/_\-]+")
_WORD = re.compile(r"\S+")
_KEYS = {"token", "secret", "password", "passwd", "passphrase", "pwd", "key", "api_key", "apikey", "api-key", "access_key", "secret_key", "private_key", "auth", "bearer", "authorization", "credential", "credentials"}
_DIGESTS = {"commit", "revision", "rev", "sha", "sha1", "sha256", "sha512", "md5", "hash", "digest", "checksum", "etag", "blob", "tree", "merge", "id", "uuid", "guid", "fingerprint"}
_KEY_IN = re.compile(r"(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential)", re.I)
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "sk-", "rk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "-----BEGIN", "-----END")
_PREFIXED = re.compile(r"[A-Za-z]{2,8}[_\-](?:[A-Za-z]{2,6}[_\-])?(?=[A-Za-z0-9_\-]*\d)[A-Za-z0-9_\-]{16,}$")
_MAIL, _UUID = re.compile(r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)+"), re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PATH = re.compile(r"(?:[.~]?/|\w:\\)?[\w.\-]+([/\\][\w.\-]+)*\.[A-Za-z]\w{0,4}")
_MARKS, _ASSIGN = ".,;:!?#$%&*|\"'=<>()[]{}`~+/_-", ("=", ":", ":=", "=>", "->")
_QUOTES, _OPEN, _AFTER = "\"'`", "\"'`([{<", ".,;:!?#$%&*\"'`)]}>"
_ASSIGNED = re.compile(r"""([\w.\-\[\]"'`({<$]+?)(?::=|=>|->|=|:(?!//))(?=[^=])""")
_NAMES = re.compile(r"token|secret|pass|pwd|key|auth|bearer|cred", re.I)
_STEPS = np.array([4, 8, 12, 16, 20, 24, 32, 40, 48, 64, 80])


def core(word: str) -> str:
    """The longest run of characters that keys are made of."""
    return max(_CORE.findall(word), key=len, default="")


def secret_part(word: str) -> tuple[int, int]:
    """Where in a word that is a secret the secret stands: after the mark of an assignment whose left side names a key or is plain letters, and
    without quotes, brackets and trailing marks around it. Marks and dots within stay."""
    b, e = 0, len(word)
    if (m := _ASSIGNED.match(word)) and (_NAMES.search(m[1]) or m[0] == f"{m[1]}=" and m[1].replace("_", "").isalpha()):
        b = m.end()
    while b < e and word[b] in _OPEN:
        b += 1
    if b and word[b - 1] in _QUOTES and (at := word.rfind(word[b - 1], b)) >= 0 and not word[at + 1 :].strip(_AFTER):
        e = at
    else:
        while b < e and word[e - 1] in _AFTER:
            e -= 1
    return (b, e) if b < e else (0, len(word))


def attributes(word: str) -> tuple[str, ...]:
    """The shape of a word, as the model sees it."""
    plain = word.strip(_MARKS)
    if (not plain or plain.isalpha() and plain.lower() not in _KEYS and plain.lower() not in _DIGESTS and not plain.startswith(("AKIA", "ASIA"))) and "-----" not in word:
        case = "low" if plain.islower() else "title" if plain[1:].islower() else "up" if plain.isupper() else "mixed"
        return ("alpha" + case if plain else "marks", f"n{min(3, len(plain) // 12)}", "-", "-", "assign" if word in _ASSIGN else "quoted" if word[0] in "\"'`" else "-")
    c = core(word)
    n = len(c)
    low, up, dig = any(x in c for x in string.ascii_lowercase), c.lower() != c, any(x.isdigit() for x in c)
    if c and all(x in string.hexdigits for x in c) and dig and (low or up):
        kind = "hex"
    else:
        kind = "".join(k for k, v in (("l", low), ("u", up), ("d", dig)) if v) or "none"
    if not word.isascii() and n < 0.7 * len(word):
        kind = "foreign"
    bare = word.strip("\"'`,;:=()[]{}<>").lower()
    if bare in _KEYS:
        role = "key"
    elif bare in _DIGESTS:
        role = "digest"
    elif "://" in word:
        role = "url"
    elif _MAIL.fullmatch(plain):
        role = "mail"
    elif _UUID.fullmatch(plain):
        role = "uuid"
    elif _KEY_IN.search(word):
        role = "keyed" if re.search(r"[=:][^=:]", word.rstrip(_AFTER)) else "keylike"
    elif _PATH.fullmatch(plain):
        role = "path"
    else:
        role = "quoted" if word[0] in "\"'`" else "-"
    prefix = "known" if c.startswith(_PREFIXES) else "like" if _PREFIXED.match(c) else "-"
    return (kind, f"n{np.searchsorted(_STEPS, n, 'right')}", f"distinct{len(set(c)) // 4 if n >= 12 else 0}", prefix, role)


_ROLES = ("own", "prev", "prev2", "next")


def _features(a: tuple[str, ...], role: str) -> list[str]:
    return [f"{role}|{i}|{x}" for i, x in enumerate(a)] + [f"{role}|*|{'|'.join(a)}"]


def file_class(n_words: int, odd: float) -> int:
    """Of a document: its length and how much of it looks like code or keys."""
    return (n_words > 100) + (n_words > 2000) + 3 * ((odd > 0) + (odd > 0.01) + (odd > 0.05))


def _is_odd(a: tuple[str, ...]) -> bool:
    return a[4] in ("assign", "keyed", "url") or (a[0] in ("hex", "lud", "ud", "ld") and a[1] not in ("n0", "n1"))


@dataclass
class Crf:
    weights: dict[str, np.ndarray]  # feature -> score per tag
    moves: np.ndarray  # (3, 3)
    files: np.ndarray  # (12, 3)

    def __post_init__(self):
        self.clear()

    def clear(self):
        self.shapes: dict[tuple[str, ...], int] = {}
        self.tables = {r: [np.zeros(3)] for r in _ROLES}  # shape 0: beyond a document's ends
        self.odd = [False]
        self.words: dict[str, int] = {}

    def __getstate__(self):
        return (self.weights, self.moves, self.files)

    def __setstate__(self, state):
        self.weights, self.moves, self.files = state
        self.clear()

    def shape(self, word: str) -> int:
        if len(self.words) > 400_000:
            self.words.clear()
        a = attributes(word)
        if (k := self.shapes.get(a)) is None:
            k = self.shapes[a] = len(self.odd)
            self.odd.append(_is_odd(a))
            for r in _ROLES:
                self.tables[r].append(sum((self.weights[f] for f in _features(a, r) if f in self.weights), np.zeros(3)))
        self.words[word] = k
        return k

    def decode(self, docs: list[list[str]]) -> list[list[tuple[int, int]]]:
        """Viterbi over each document; the spans (first word, end) of its secrets.

        A word whose lead for OUT exceeds whatever the moves around it could give to another tag is OUT in the best path; the
        chains between such words are short, and those of one length are decoded together. The result is that of the full search.
        """
        known, ids, starts, classes = self.words, [0, 0], [], []
        for words in docs:
            starts.append(len(ids))
            found = [known[w] if w in known else self.shape(w) for w in words]
            ids += found
            ids += (0, 0)
            classes.append(file_class(len(words), sum(map(self.odd.__getitem__, found)) / max(1, len(found))))
        s = np.array(ids)
        t = {r: np.array(v) for r, v in self.tables.items()}
        emit = t["own"][s]
        emit[1:] += t["prev"][s[:-1]]
        emit[2:] += t["prev2"][s[:-2]]
        emit[:-1] += t["next"][s[1:]]
        lengths = [len(w) for w in docs]
        emit += np.concatenate([np.zeros((2, 3)), *(np.concatenate([np.broadcast_to(self.files[c], (n, 3)), np.zeros((2, 3))]) for c, n in zip(classes, lengths))])
        m = self.moves
        lead = [(m[:, k, None] + m[None, k, :] - m[:, OUT, None] - m[None, OUT, :]).max() for k in (BEGIN, IN)]
        out = (emit[:, OUT] - emit[:, BEGIN] > lead[0]) & (emit[:, OUT] - emit[:, IN] > lead[1])
        out[s == 0] = True
        tags = np.zeros(len(s), np.int8)
        edge = np.diff(np.concatenate([[True], out, [True]]).astype(np.int8))
        first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        for n in np.unique(end - first):
            at = first[end - first == n][:, None] + np.arange(n)
            tags[at] = self._best(emit[at])
        spans = []
        for b, n in zip(starts, lengths):
            got = []
            hits = np.flatnonzero(tags[b : b + n])
            for i in hits.tolist():
                if got and got[-1][1] == i and tags[b + i] == IN:
                    got[-1] = (got[-1][0], i + 1)
                else:
                    got.append((i, i + 1))
            spans.append(got)
        return spans

    def _best(self, emit: np.ndarray) -> np.ndarray:
        """Best tags of chains (chain, word, tag) that have OUT on either side."""
        chains, n, _ = emit.shape
        score, back = self.moves[OUT] + emit[:, 0], np.zeros((chains, n, 3), np.int8)
        for i in range(1, n):
            step = score[:, :, None] + self.moves
            back[:, i] = step.argmax(1)
            score = step.max(1) + emit[:, i]
        tags = np.zeros((chains, n), np.int8)
        tags[:, -1] = (score + self.moves[:, OUT]).argmax(1)
        for i in range(n - 1, 0, -1):
            tags[:, i - 1] = back[np.arange(chains), i, tags[:, i]]
        return tags


_LOW, _UP, _DIG = string.ascii_lowercase, string.ascii_uppercase, string.digits
_KEY_CHARS = _LOW + _UP + _DIG + "+/=_-."


def _pick(r: random.Random, chars: str, n: int) -> str:
    return "".join(r.choice(chars) for _ in range(n))


def _secret(r: random.Random) -> list[str]:
    """A made-up key: runs over the alphabets that keys are written in, bare or with a prefix, web tokens, key blocks, passwords."""
    an, n = _LOW + _UP + _DIG, r.randint(16, 64)
    kind = r.randrange(9)
    if kind < 2:
        x = _pick(r, "0123456789abcdef", n)
        return [x.upper() if r.random() < 0.3 else x]
    if kind == 2:
        return [_pick(r, an, n)]
    if kind == 3:
        return [_pick(r, an + "+/", n) + r.choice(("", "=", "=="))]
    if kind == 4:
        return [_pick(r, _UP + _DIG, r.randint(16, 32))]
    if kind == 5:
        return [r.choice(_PREFIXES[:14]) + _pick(r, r.choice((an, _UP + _DIG, an + "-_")), r.randint(16, 48))]
    if kind == 6:
        sep = r.choice("_-")
        return [_pick(r, _LOW, r.randint(2, 6)) + sep + r.choice(("", "live" + sep, "test" + sep, "pat" + sep)) + _pick(r, an, r.randint(16, 48))]
    if kind == 7:
        if r.random() < 0.5:
            return [f"eyJ{_pick(r, an, r.randint(12, 30))}.eyJ{_pick(r, an, r.randint(20, 90))}.{_pick(r, an + '-_', 43)}"]
        of = r.choice(("RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY")).split()
        return ["-----BEGIN", *of[:-1], "KEY-----", *(_pick(r, an + "+/", 64) for _ in range(r.randint(1, 4))), "-----END", *of[:-1], "KEY-----"]
    return [_pick(r, an + "!@#$%^&*.-_", r.randint(10, 20)) + r.choice(_DIG)]


def _harmless(r: random.Random) -> list[str]:
    """What may look like a key and is none."""
    word = lambda: _pick(r, _LOW, r.randint(2, 9))
    kind = r.randrange(18)
    if kind == 16:
        x = r.choice((r.choice(sorted(_DIGESTS | _KEYS)), _name(r)))
        return [r.choice((x, x.title(), x.upper())) + r.choice(("", *string.punctuation))]
    if kind == 17:
        x = word() + r.choice(string.punctuation) + word()
        return [r.choice((x, x.title(), x.upper())) + r.choice(("", *string.punctuation))]
    if kind == 0:
        return [_pick(r, _DIG, r.randint(1, 20))]
    if kind == 1:
        return [r.choice("-./: ,").join(_pick(r, _DIG, r.randint(1, 4)) for _ in range(r.randint(2, 4)))]
    if kind == 2:
        return [f"{word()}{r.choice('._-+')}{r.choice((word(), _pick(r, _DIG, 3)))}@{word()}.{r.choice(('com', 'org', 'net', 'co.uk', 'de'))}"]
    if kind == 3:
        return [f"http{r.choice(('', 's'))}://{word()}.{word()}/{word()}/{_pick(r, _LOW + _DIG, r.randint(4, 24))}"]
    if kind == 4:
        return [_pick(r, _LOW, r.randint(12, 40))]
    if kind == 5:
        return [r.choice("_-.").join(word() for _ in range(r.randint(2, 6)))]
    if kind == 6:
        return ["".join(word().title() for _ in range(r.randint(2, 5))) + r.choice(("", "()", _pick(r, _DIG, 2)))]
    if kind == 7:
        return [_pick(r, _UP, r.randint(4, 24))]
    if kind == 8:
        return [r.choice(("/", "./", "~/", "")) + "/".join(word() for _ in range(r.randint(1, 4))) + "." + r.choice(("py", "txt", "json", "tar", "h5"))]
    if kind == 9:
        return ["-".join(_pick(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12))]
    if kind < 12:
        return [*r.choice((["commit"], ["revision"], ["sha256"], ["sha1", "="], ["md5", ":"], ["checksum:"], ["digest"], ["etag"])), _pick(r, "0123456789abcdef", r.choice((7, 12, 32, 40, 64)))]
    if kind == 12:
        return ["#" + _pick(r, "0123456789abcdef", r.choice((3, 6, 8)))]
    if kind == 13:
        return [*r.choice((["the", "token"], ["a", "password", "is"], ["key", ":"], ["secret", "="], ["token", "="], ["auth"])), word()]
    if kind == 14:
        return [r.choice(("token", "password", "api_key", "secret")) + r.choice(("=", ": ", "=")) + r.choice(("", '"', "<", "${")) + r.choice((word(), "null", "true", "example", "changeme", "x" * r.randint(4, 30), "*" * 8))]
    return [f"v{r.randrange(30)}.{r.randrange(30)}.{r.randrange(30)}-{word()}{r.randrange(9)}"]


def _name(r: random.Random) -> str:
    """What a key may be called: the plain names, also with other words before or after."""
    key, sep, word = r.choice(sorted(_KEYS)), r.choice("_-"), _pick(r, _LOW, r.randint(2, 8))
    return r.choice((key, key, f"{word}{sep}{key}", f"{word}{sep}{key}", f"{key}{sep}{word}"))


def _marked(r: random.Random, word: str) -> str:
    return word + r.choice(string.punctuation) * r.randint(1, 3)


def plant(words: list[str], r: random.Random) -> tuple[list[str], list[int]]:
    """A window of a document with secrets and harmless look-alikes put in, and the tags of its words."""
    words, tags = list(words), [OUT] * len(words)
    for _ in range(r.randint(1, 3)):
        at = r.randint(0, len(words))
        if r.random() < 0.5:
            x = [w for part in _harmless(r) for w in part.split()]
            t = [OUT] * len(x)
        else:
            x = _secret(r)
            t = [BEGIN] + [IN] * (len(x) - 1)
            if len(x) == 1:
                q, key = r.choice(('"', '"', "'", "`", "", "")), _name(r)
                key = key.upper() if r.random() < 0.2 else key
                x = [q + x[0] + q]
                form = r.randrange(7 if all(w in _KEY_CHARS for w in x[0].strip(q)) else 5)  # a password stands by its name
                if form < 2:
                    x, t = [key, r.choice(_ASSIGN), *x], [OUT, OUT, *t]
                elif form == 2:
                    x = [r.choice(("", "--", "export_", "?", "my_")) + key + r.choice("=:") + x[0]]
                elif form == 3:
                    x, t = [r.choice((f"{key}:", f'"{key}":', f"--{key}")), *x], [OUT, *t]
                elif form == 4:
                    x, t = [key, r.choice(("is", "was", "use", "")) or "=", *x], [OUT, OUT, *t]
                if r.random() < 0.3:
                    x[-1] = _marked(r, x[-1])
        words[at:at], tags[at:at] = x, t
    return words, tags


def may_hold_key(word: str) -> bool:
    """A word of a sampled text of which it isn't known whether it is a key: long, with digits in it. No window trains on one."""
    c = core(word)
    return len(c) >= 12 and any(x.isdigit() for x in c) and any(x.isalpha() for x in c) or "KEY-----" in word


def cut_windows(text: str | None, seed: int, most: int = 2, width: int = 10) -> list[tuple[list[str], int]]:
    """Windows of a text that hold nothing like a key, from anywhere in it, each with the number of words of the text."""
    words, r, out = (text or "").split(), random.Random(seed), []
    for _ in range(most if words else 0):
        b = r.randrange(max(1, len(words) - width + 1))
        own = words[b : b + width]
        if not any(map(may_hold_key, own)):
            out.append((own, len(words)))
    return out


def examples(cut: list[tuple[list[str], int]], seed: int, most: int = 3000) -> list[tuple[list[str], list[int], int]]:
    """Windows with planted keys and look-alikes: words, tags and the class of the file. Some are in capitals or have marks put after words."""
    r, out = random.Random(seed), []
    cut = cut or [(["a"], 1)]
    for k in range(most):
        own, n = cut[k % len(cut)]
        noise = r.random()
        if noise < 0.1:
            own = [w.upper() for w in own]
        if 0.05 < noise < 0.2:
            own = [_marked(r, w) if r.random() < 0.3 else w for w in own]
        out.append((*plant(own, r), file_class(n if r.random() < 0.5 else r.choice((20, 500, 5000)), r.choice((0, 0.005, 0.03, 0.1)))))
    return out


def train(examples: list[tuple[list[str], list[int], int]], epochs: int = 8, rate: float = 0.08, batch: int = 150, seed: int = 5) -> Crf:
    """Maximum likelihood by forward-backward sums and Adam, with a pull of the weights towards zero.

    Scores are summed for each shape of a word that occurs, and gradients too, before they are spread over its features."""
    index: dict[str, int] = {}
    shapes: dict[tuple[str, ...], int] = {}
    known: dict[str, int] = {}
    rows = [[known[w] if w in known else known.setdefault(w, shapes.setdefault(attributes(w), len(shapes) + 1)) for w in words] for words, _, _ in examples]
    feats = {r: np.array([[0] * 6, *([index.setdefault(f, len(index) + 1) for f in _features(a, r)] for a in shapes)]) for r in _ROLES}  # shape 0: beyond the ends
    order = sorted(range(len(examples)), key=lambda k: len(rows[k]))
    size, steps = len(index) + 1, max(1, len(order) // batch)
    theta = np.zeros((size + 12 + 3, 3))  # features, file classes, moves
    m1, m2, step = np.zeros_like(theta), np.zeros_like(theta), 0
    rng, eye = np.random.default_rng(seed), np.eye(3)
    lse = lambda z, ax: (mx := z.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(z - mx).sum(ax))
    batches = []
    for pick in np.array_split(order, steps):  # windows of like lengths
        longest = max(len(rows[k]) for k in pick)
        s, y = np.zeros((len(pick), longest + 3), np.int64), np.zeros((len(pick), longest), np.int64)
        for i, k in enumerate(pick):
            s[i, 2 : 2 + len(rows[k])], y[i, : len(rows[k])] = rows[k], examples[k][1]
        batches.append((s, y, np.array([examples[k][2] for k in pick])))
    for _ in range(epochs):
        for at in rng.permutation(len(batches)):
            s, y, files = batches[at]
            b, n = y.shape
            on, moves = s[:, 2:-1] > 0, theta[-3:]
            beside = {"own": s[:, 2:-1], "prev": s[:, 1:-2], "prev2": s[:, :-3], "next": s[:, 3:]}
            emit = theta[size + files][:, None] + sum(theta[feats[r]].sum(1)[x] for r, x in beside.items())
            emit[~on] = (0, -50, -50)
            fwd, bwd = np.zeros((b, n + 1, 3)), np.zeros((b, n + 1, 3))
            fwd[:, 0] = (0, -1e3, -1e3)
            for i in range(n):
                fwd[:, i + 1] = lse(fwd[:, i, :, None] + moves, 1) + emit[:, i]
            bwd[:, n] = moves[:, OUT]
            for i in range(n - 1, -1, -1):
                bwd[:, i] = lse(moves + (emit[:, i] + bwd[:, i + 1])[:, None, :], 2)
            z = lse(fwd[:, n] + bwd[:, n], 1)
            post = np.exp(fwd[:, 1:] + bwd[:, 1:] - z[:, None, None])
            pair = np.exp(fwd[:, :-1, :, None] + moves + (emit + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
            before = np.concatenate([np.zeros((b, 1), np.int64), y[:, :-1]], 1)
            diff = (eye[y] - post) * on[:, :, None]
            grad = np.zeros_like(theta)
            for r, x in beside.items():
                by_shape = np.stack([np.bincount(x.ravel(), diff[:, :, tag].ravel(), minlength=len(shapes) + 1) for tag in range(3)], 1)
                for tag in range(3):
                    grad[:size, tag] += np.bincount(feats[r].ravel(), np.repeat(by_shape[:, tag], 6), minlength=size)
            grad[0] = 0
            np.add.at(grad, size + files, diff.sum(1))
            np.add.at(grad[-3:], before[on], eye[y[on]])
            grad[-3:] -= (pair * on[:, :, None, None]).sum((0, 1))
            grad = grad / b - np.concatenate([np.full((size + 12, 1), 1e-5), np.full((3, 1), 1e-3)]) * theta
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
            theta += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Crf({name: theta[i] for name, i in index.items()}, theta[-3:], theta[size:-3])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2000) -> Crf:
    """Trains on windows of at most max_docs documents, those whose ids hash lowest, with made-up keys and look-alikes planted.

    Windows come from anywhere in a text, however long it is, and are cut where the text is. Of keys that texts already hold nothing is
    learned: no window has a word that may be one. Without documents the model learns from planted windows alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, w, n) for h, t in zip(batch["h"].to_pylist(), batch["t"].to_pylist()) for w, n in cut_windows(t, h)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.list_(pa.string()), pa.int32()))], ["h", "words", "n"])

    some = among_lowest(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id", max_docs)
    made = some.select(F.xxhash64("id", "t").alias("h"), "t").mapInArrow(run, "h bigint, words array<string>, n int")
    return train(examples([(r.words, r.n) for r in made.orderBy("h", "words").limit(2 * max_docs).collect()], seed=9))


def spans(crf: Crf, texts: list[str | None], words_at_once: int = 300_000) -> list[list[tuple[int, int]]]:
    """Character spans of the secrets of each whole text; null has none. A secret of one word is what secret_part leaves of it."""
    out: list[list[tuple[int, int]]] = []
    held: list[list[str]] = []
    total = 0

    def flush() -> None:
        for text, got in zip(texts[len(out) : len(out) + len(held)], crf.decode(held)):
            places = []
            if got:
                at = [m.span() for m in _WORD.finditer(text)]
                for b, e in got:
                    s, t = at[b][0], at[e - 1][1]
                    if e - b == 1:
                        b, e = secret_part(text[s:t])
                        s, t = s + b, s + e
                    places.append((s, t))
            out.append(places)
        held.clear()

    for text in texts:
        held.append((text or "").split())
        total += len(held[-1])
        if total >= words_at_once:
            flush()
            total = 0
    flush()
    return out


def masked(crf: Crf, text: Column) -> Column:
    """The text with a mask in the place of each secret; null stays null."""

    @F.arrow_udf("string")
    def f(a: pa.Array) -> pa.Array:
        texts = a.to_pylist()
        for i, found in enumerate(spans(crf, texts)):
            for s, e in reversed(found):
                texts[i] = texts[i][:s] + MASK + texts[i][e:]
        return pa.array(texts, pa.string())

    return f(text)


def scan(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, sha256), one for each secret found; the secret itself is not repeated.

    Null and empty texts have none. Repeated rows are reported as often as they occur, a null id with its row. Other columns of docs
    are not used, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["t"].to_pylist()
            rows = [(i, b, e, hashlib.sha256(texts[i][b:e].encode()).hexdigest()) for i, got in enumerate(spans(crf, texts)) for b, e in got]
            at, *rest = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(rest, (pa.int32(), pa.int32(), pa.string())))], ["id", "start", "end", "sha256"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, start int, end int, sha256 string")
    return found.select(F.col("id").alias(id_col), "start", "end", "sha256")


def mask_secrets(docs: DataFrame, crf: Crf, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with its secrets masked and its count of characters, if it has one, made anew. Null and empty texts stay, repeated rows too."""
    out = docs.withColumn(text_col, masked(crf, F.col(text_col)))
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)).select(*columns(docs)) if chars_col in docs.columns else out
