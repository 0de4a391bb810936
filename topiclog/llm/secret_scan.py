"""Secret scans: patterns propose candidates, a random forest takes the false positives out.

The forest sees a candidate's length, its character transitions, how much of it dictionary words cover, whether it
is part of a path, and the words around it. It is trained here from labelled findings; `labelled_findings` makes a fixed set
of them from the kinds of strings that secrets and their look-alikes are. Nothing of it depends on the corpus.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topiclog.llm.common import SLICE, slices

_RUN = "[0-9A-Za-z_-]"
# How known kinds of secrets are written. No pattern starts twice in one run of characters and reads it to the end, so each takes linear time.
PATTERNS = [
    r"(?P<aws_key>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)",
    r"(?P<github_token>\bgh[pousr]_[0-9A-Za-z]{36}\b)",
    r"(?P<slack_token>\bxox[abprs]-[0-9A-Za-z-]{10,})",
    r"(?P<payment_key>\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b)",
    # the run's end is looked at once, where it begins; only then its first "eyJ" is searched
    rf"(?<!{_RUN})(?={_RUN}{{11,}}+\.{_RUN}{{8,}}+\.{_RUN}{{8}}){_RUN}*?(?P<web_token>\beyJ{_RUN}{{8,}}+\.{_RUN}{{8,}}+\.{_RUN}{{8,}}+)",
    r"(?P<private_key>-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[0-9A-Za-z+/=\s]{32,}+-----END)",
    r"(?ai:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential)s?[\"']?[ \t]{0,4}(?:=>|:=|=|:)[ \t]{0,4}[\"']?(?P<assigned>[^\s\"'`<>,;]{6,})",
    r"(?<![0-9A-Za-z+/_=-])(?P<random_text>(?=[A-Za-z+/_-]*+[0-9])[0-9A-Za-z+/_-]{16,}+={0,2})(?![0-9A-Za-z+/_=-])",
]
CANDIDATE = re.compile("|".join(PATTERNS))
#: In lower case, a text without a digit and without any of these has no candidate, as each alternative above needs one: most texts end here.
HINTS = "akia asia ghp_ gho_ ghu_ ghs_ ghr_ xox k_live_ k_test_ eyj -----begin pass pwd secret token api access auth credential".split()
DIGIT = re.compile("[0-9]")
SECRET_WORDS = frozenset("password passwd passphrase pass pwd secret token api apikey key access auth authorization credential credentials bearer private login".split())
HARMLESS_WORDS = frozenset("commit sha sha1 sha256 md5 hash checksum digest revision uuid guid id etag version build example sample placeholder dummy test fixture integrity blob object ref file path image src url card phone number".split())
#: Words of configuration files and programs; dictionary() adds those of a tokenizer's vocabulary.
CODE_WORDS = frozenset(
    "the and for that with this from your you are have not key password secret token example sample test user admin login change replace insert default value name data file path image index main class public private static return function import "
    "config settings server client account service access local host home page search result string number list table object version update delete create read write error message time date year here there what when where which will would could should "
    "your_key placeholder changeme xxxx none null true false undefined todo hello world foo bar baz lorem ipsum dummy abc qwerty letmein".split()
)
NAMES = [
    *("length", "upper", "lower", "digits", "other", "entropy", "distinct", "transitions", "case_turns", "digit_turns", "longest_run", "longest_same"),
    *("hex_only", "upper_digits", "vowels", "pair_commonness", "coverage", "longest_word", "in_path", "dots", "file_ending", "uuid", "sequence"),
    *("secret_word_near", "harmless_word_near", "assigned", "quoted", "known_prefix", "random_kind"),
]
COMMON_PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())


@cache
def dictionary(vocabulary: str | None = None) -> frozenset[str]:
    """CODE_WORDS and the words of four or more letters that a byte-level vocabulary (a tokenizers file) has as one token behind a space."""
    if vocabulary is None:
        return CODE_WORDS
    with open(vocabulary, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    return CODE_WORDS | {x[1:].lower() for x in entries if re.fullmatch("\u0120[A-Za-z][a-z]{3,11}", x)}


def _coverage(text: str, known: frozenset[str]) -> tuple[float, int]:
    """Share of the text that dictionary words of four or more letters cover (longest first from the left), and the longest of them."""
    low, at, covered, longest = text.lower(), 0, 0, 0
    while at < len(low):
        for n in range(min(12, len(low) - at), 2, -1):
            if low[at : at + n] in known and (n > 3 or n == len(low)):
                covered, longest, at = covered + n, max(longest, n), at + n
                break
        else:
            at += 1
    return covered / len(low), longest


#: What a character is, as one letter: l lower case, u upper case, d digit, o anything else.
CLASS = {c: "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in map(chr, range(128))}


def features(value: str, before: str, after: str, kind: str, known: frozenset[str] = CODE_WORDS) -> list[float]:
    """NAMES of a whole candidate with the text in front of it and behind it (48 characters each are looked at); linear in its length."""
    n, low = len(value), value.lower()
    classes = "".join(CLASS.get(c) or ("l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o") for c in value)
    share = {k: classes.count(k) / n for k in "luo"} | {"d": classes.count("d") / n}
    tally = [k / n for k in Counter(value).values()]
    runs = [(k, sum(1 for _ in g)) for k, g in groupby(classes)]
    turns = Counter("".join(sorted(a + b)) for (a, _), (b, _) in pairwise(runs))
    letters = sum(map(str.isalpha, low))
    pairs = Counter(a + b for a, b in pairwise(low) if a.isalpha() and b.isalpha())
    coverage, longest_word = _coverage(value, known)
    near = re.findall(r"[A-Za-z0-9]+", before[-48:].lower())[-4:]
    behind = re.findall(r"[A-Za-z0-9]+", after[:48].lower())[:2]
    return [
        n,
        share["u"],
        share["l"],
        share["d"],
        share["o"],
        -sum(p * math.log2(p) for p in tally),
        len(tally) / n,
        (len(runs) - 1) / n,
        turns["lu"] / n,
        sum(k for t, k in turns.items() if "d" in t) / n,
        max(k for _, k in runs) / n,
        max(sum(1 for _ in g) for _, g in groupby(value)) / n,
        bool(re.fullmatch(r"[0-9a-f]++|[0-9A-F]++", value)),
        bool(re.fullmatch(r"[0-9A-Z]++", value)),
        sum(low.count(c) for c in "aeiou") / max(1, letters),
        sum(k for p, k in pairs.items() if p in COMMON_PAIRS) / max(1, sum(pairs.values())),
        coverage,
        longest_word,
        value.count("/") + before[-1:].count("/") + after[:1].count("/"),
        value.count(".") + value.count("_") + value.count("-"),
        bool(re.match(r"\.[a-z]{2,4}\b", after)) or bool(re.search(r"\.[a-z]{2,4}$", value[-6:])),
        bool(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)),
        sum(ord(b) - ord(a) == 1 for a, b in pairwise(value)) / n,
        sum(w in SECRET_WORDS for w in near),
        sum(w in HARMLESS_WORDS for w in near + behind),
        kind == "assigned",
        before[-1:] in ("'", '"') or after[:1] in ("'", '"'),
        kind not in ("assigned", "random_text"),
        kind == "random_text",
    ]


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end (code points) and kind of each candidate, left to right, not overlapping."""
    low = text.lower()
    if not DIGIT.search(text) and not any(h in low for h in HINTS):
        return
    for m in CANDIDATE.finditer(text):
        kind = m.lastgroup
        start, end = m.span(kind)
        if kind == "assigned":
            while end - start > 6 and text[end - 1] in ".)]}*#&%$|!?":
                end -= 1
        yield start, end, kind


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """n findings: value, before, after, kind, and 1 for a secret or 0 for a look-alike."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choices(chars, k=k))
    alnum, hexes, words = string.ascii_letters + string.digits, "0123456789abcdef", sorted(CODE_WORDS)
    syllables = "an er th in on re st ti ha nd ou es en al de la que ie os ar ment ion el".split()
    prose = lambda k: " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(k))
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "db_password"]
    out = []

    def add(value, before, after, kind, label):
        out.append((value, f"{prose(rnd.randint(0, 6))} {before}", f"{after} {prose(rnd.randint(0, 4))}", kind, label))

    while len(out) < n:
        name = rnd.choice(names)
        name = rnd.choice([name, name.upper(), name.title()])
        sign, quote = rnd.choice([" = ", "=", ": ", " := "]), rnd.choice(['"', "'", ""])
        lead = f"{name}{sign}{quote}"
        for value in (pick(hexes, rnd.choice([16, 18, 24, 32, 40, 64])), pick(alnum, rnd.randint(10, 48)), pick(alnum + "+/", 40), pick(alnum + "!@#$%^&*-_", rnd.randint(8, 24)), rnd.choice(words) + pick(string.digits + "!#%", rnd.randint(3, 6)) + pick(alnum, 3)):
            add(value, lead, quote, "assigned", 1)
        add("AKIA" + pick(string.ascii_uppercase + string.digits, 16), rnd.choice(["", lead, "key id "]), "", "aws_key", 1)
        add("gh" + rnd.choice("pousr") + "_" + pick(alnum, 36), rnd.choice(["", lead]), quote, "github_token", 1)
        add("xox" + rnd.choice("abp") + "-" + pick(string.digits, 12) + "-" + pick(alnum, 24), rnd.choice(["", lead]), quote, "slack_token", 1)
        add(rnd.choice("sr") + "k_live_" + pick(alnum, 24), rnd.choice(["", lead]), quote, "payment_key", 1)
        add("eyJ" + pick(alnum, 20) + "." + pick(alnum + "_-", 40) + "." + pick(alnum + "_-", 43), rnd.choice(["Bearer ", lead]), quote, "web_token", 1)
        add(pick(alnum + "+/", 40), rnd.choice(["secret ", "key ", "login token "]), "", "random_text", 1)
        # look-alikes
        harmless = rnd.choice(["commit ", "sha256:", "md5 ", "checksum ", "revision ", "etag ", "blob "])
        add(pick(hexes, rnd.choice([32, 40, 64])), harmless, "", "random_text", 0)
        u = pick(hexes, 32)
        add(f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", rnd.choice(["uuid ", "id: ", ""]), "", "random_text", 0)
        add("/".join(rnd.choices(words, k=4)) + pick(string.digits, 2), rnd.choice(["src/", "path ", "https://host/"]), rnd.choice([".py", ".html", "/x"]), "random_text", 0)
        add("_".join(rnd.choices(words, k=4)) + pick(string.digits, 1), rnd.choice(["function ", "class ", ""]), "", "random_text", 0)
        add("".join(rnd.choices(syllables, k=rnd.randint(9, 14))) + pick(string.digits, rnd.randint(1, 2)), "", "", "random_text", 0)
        add(rnd.choice(["changeme", "your_password", "your-token-here", "xxxxxxxx", "placeholder", "<secret>", "********", "example_key", "replace_me", "undefined", "password", "None", "secret_value", "test_password", "${PASSWORD}", "os.environ", "getenv(KEY)", "self.password", "request.token", "config.secret"]), lead, quote, "assigned", 0)
        add("".join(rnd.choices(syllables, k=rnd.randint(3, 6))), f"{name}: ", rnd.choice(["", ".", ","]), "assigned", 0)
        add("_".join(rnd.choices(words, k=rnd.randint(2, 3))), lead, quote, "assigned", 0)
        add("".join(rnd.choices(words, k=rnd.randint(2, 3))), lead, quote, "assigned", 0)
        add(pick(string.digits, rnd.randint(16, 20)), rnd.choice(["card ", "order ", "pay ", "number ", "invoice ", ""]), "", "random_text", 0)
        add("-".join(pick(string.digits, 4) for _ in range(4)), rnd.choice(["card ", "serial ", ""]), "", "random_text", 0)
        add("AKIA" + rnd.choice(["IOSFODNN7EXAMPLE", "X" * 16, "EXAMPLE" + "0" * 9, "0123456789ABCDEF"]), rnd.choice(["example ", "sample ", lead]), "", "aws_key", 0)
        add("gh" + rnd.choice("ps") + "_" + rnd.choice(["x", "0", "a"]) * 36, rnd.choice(["placeholder ", lead]), "", "github_token", 0)
        add("sk_test_" + rnd.choice(["x" * 24, "example" * 4, "0" * 24]), lead, quote, "payment_key", 0)
        add(rnd.choice(["abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"]), rnd.choice(["", "alphabet ", lead]), "", "random_text", 0)
    return out[:n]


@dataclass
class Forest:
    """Random forest in arrays, all trees in one: a node's children are left and left + 1; leaves point at themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    share: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            leaf = self.left[at] < 0
            at = np.where(leaf, at, self.left[at] + (x[rows, self.feature[at]] > self.threshold[at]))
        return self.share[at].mean(1)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 11) -> Forest:
    """Trees on bootstrap samples; each split looks at the square root of the features' number and takes the lowest Gini impurity."""
    rnd, nodes, roots = np.random.default_rng(seed), [], []
    some = max(1, math.isqrt(x.shape[1]))

    def split(rows: np.ndarray) -> tuple[int, float] | None:
        best = None
        for f in rnd.choice(x.shape[1], some, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            ok = np.flatnonzero((v[1:] > v[:-1]) & (n >= least) & (len(order) - n >= least))
            if not len(ok):
                continue
            a, m, b, r = ones[:-1][ok], n[ok], ones[-1] - ones[:-1][ok], len(order) - n[ok]
            impure = a * (m - a) / m + b * (r - b) / r
            k = int(impure.argmin())
            if best is None or impure[k] < best[0]:
                best = impure[k], int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2)
        return best and best[1:]

    for _ in range(trees):
        rows = rnd.integers(0, len(y), len(y))
        roots.append(len(nodes))
        nodes.append([0, 0.0, -1, float(y[rows].mean())])
        stack = [(roots[-1], rows, 0)]
        while stack:
            node, rows, d = stack.pop()
            if d == depth or not 0 < nodes[node][3] < 1 or not (found := split(rows)):
                continue
            nodes[node][:3] = [*found, len(nodes)]
            right = x[rows, found[0]] > found[1]
            for part in (rows[~right], rows[right]):
                stack.append((len(nodes), part, d + 1))
                nodes.append([0, 0.0, -1, float(y[part].mean())])
    feature, threshold, left, share = (np.array(c) for c in zip(*nodes, strict=True))
    return Forest(np.array(roots), feature, threshold, left, share, depth)


@dataclass
class Scanner:
    """What judges candidates: a forest of some thousand nodes, and the dictionary of at most some ten thousand words that its features use."""

    forest: Forest
    known: frozenset[str]

    def findings(self, texts: Iterable[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """For each text its candidates: start, end, kind and the forest's share of votes for a secret."""
        places, rows = [], []
        for text in texts:
            own = list(candidates(text)) if text else []
            places.append(own)
            rows += [features(text[a:b], text[max(0, a - 64) : a], text[b : b + 64], kind, self.known) for a, b, kind in own]
        x = np.array(rows, float)
        votes = iter(np.concatenate([self.forest.predict(x[k : k + 2048]) for k in range(0, len(rows), 2048)]) if rows else [])
        return [[(a, b, kind, float(next(votes))) for a, b, kind in own] for own in places]


@cache
def default_forest(vocabulary: str | None = None) -> Forest:
    found, known = labelled_findings(), dictionary(vocabulary)
    return grow_forest(np.array([features(*f[:4], known) for f in found], float), np.array([f[4] for f in found]))


def trained(vocabulary: str | None = None) -> Scanner:
    """The scanner of the generated findings; vocabulary is the path of a tokenizers file that the driver reads the dictionary from."""
    return Scanner(default_forest(vocabulary), dictionary(vocabulary))


def findings(texts: Iterable[str | None], forest: Forest, known: frozenset[str] = CODE_WORDS) -> list[list[tuple[int, int, str, float]]]:
    return Scanner(forest, known).findings(texts)


def scan(docs: DataFrame, scanner: Scanner | None = None, least_votes: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (array of start, end, kind, votes; code points) of every row.

    A candidate is a secret if at least least_votes of the trees say so. Whole texts are scanned, and candidates have no upper length; null and
    empty texts have none; rows that repeat are scanned each; a null doc_id stays null (ids are integers, or texts of integers); other columns
    are ignored. One pass, no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(scanner or trained())
    spot = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("votes", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            found = model.value.findings(batch.column("text").to_pylist())
            kept = [[dict(zip(("start", "end", "kind", "votes"), x, strict=True)) for x in own if x[3] >= least_votes] for own in found]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([len(x) for x in kept], pa.int64()), pa.array(kept, pa.list_(spot))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_candidates", "n_secrets", "secrets"])

    schema = "doc_id long, n_candidates long, n_secrets long, secrets array<struct<start:int,end:int,kind:string,votes:double>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def redact(text: str | None, spots: Iterable[tuple[int, int]] | None, mark: str = "[secret]") -> str | None:
    """The text with each span replaced by the mark; spans that overlap become one. A null text stays null, null spans are none."""
    if text is None:
        return None
    out, at = [], 0
    for start, end in sorted(spots or []):
        if start >= at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
