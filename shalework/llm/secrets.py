"""Credentials embedded in code, comments and configuration: found across the corpus, and masked in place.

1. Every text is searched for literals that may be credentials: values with a structure of their own (key blocks, signed tokens,
   keys with a known prefix), values in a telling position (after a key word, in a header, a connection string, a URL, as the key of
   a cipher) and literals that merely look random.
2. These literals are indexed over the whole corpus with the number of their owners (application files). What a share of all owners
   has in common and what has no structure (no digit in it, a mask, a value that calls itself a sample) is suppressed as a
   placeholder; a rare value is confirmed if it has the structure of a value at all, so masks and stand-ins are not. Key blocks and
   prefixed or signed tokens are confirmed however many owners they have.
3. Every text is scanned again, once, for the confirmed values, which finds them in places that tell nothing.

The scan's automaton has the upper levels of the trie of all confirmed values: as many characters of each as a bounded number of states
allows. Where it arrives at a leaf, the lengths of the values below the leaf and a Bloom filter over whole values decide whether the
text at hand is a hit, and a join of the hits with the confirmed values decides for good. More values make the automaton less deep, not the
scans more. Values that a pattern recognises anywhere (key blocks, prefixed and signed tokens) are not in it. Which hits are parts of longer ones is
decided after the join, over all hits of a text.

Defined results. Null and empty texts hold no credential. A value that stands in a field several times, or in a record that was
delivered more than once, is one row. Text around a masked value stays as it is, byte for byte.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shalework.llm import bitmap
from shalework.session import cut

#: A value is widely shared from so many owners on, and from this share of all owners.
SHARED_OWNERS, SHARED_PART = 5, 0.1
#: Characters in the scan's automaton (about 80 bytes each in memory), and the most levels it has.
BLOCK_CHARS, DEPTH = 1_500_000, 24
#: Values of this length and more are looked up by so many of their characters, and compared in full after that.
LONG = 120
MASK = "********"

KEY, TOKEN, NAMED, BARE, MASKED = "key", "token", "named", "bare", "masked"

# Words that announce a credential, in the languages of the corpus.
_WORD = r"(?:pass(?:word|wort|phrase|wd|code)?|pwd|pw|kennwort|mdp|mot de passe|contrase(?:ñ|n)a|clave|パスワード|secret|token|credentials?)"
_NAME = rf"(?:[\w-]*?(?:{_WORD}|api[_-]?key|(?:access|secret|private|sign(?:ing)?|auth|enc(?:ryption)?)[_-]?key)|key|apikey|sig|signature|auth)"
_I = re.IGNORECASE

#: Values that are credentials wherever they stand: kind, what the lower-case text must hold (any of), pattern.
_SELF = tuple(
    (kind, needles, re.compile(p))
    for kind, needles, p in (
        (KEY, ("private key",), r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"),
        (TOKEN, ("eyj",), r"(?<![\w-])(eyJ[\w-]{6,}\.[\w-]{6,}\.[\w-]{6,})"),
        (TOKEN, ("akia", "asia"), r"(?<![A-Za-z0-9])(A[KS]IA[0-9A-Z]{16})(?![A-Za-z0-9])"),
        (TOKEN, ("k_live_", "k_test_"), r"(?<![A-Za-z0-9_])([srp]k_(?:live|test)_[A-Za-z0-9]{12,})"),
        (TOKEN, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-"), r"(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,})"),
        (TOKEN, ("xox",), r"(?<![A-Za-z0-9_])(xox[abeprs]-[A-Za-z0-9-]{10,})"),
        (TOKEN, ("-",), r"(?<![\w-])([a-z]{3,6}(?:-[0-9a-f]{8}){3,4})(?![\w-])"),
    )
)

#: Values in a telling position: what the lower-case text must hold (any of; of a tuple all parts), and the pattern; group 1 is the
#: value. Only what every match holds may stand here, so no spacing that a pattern leaves open.
_PLACED = tuple(
    (tuple((n,) if isinstance(n, str) else n for n in needles), re.compile(p, _I))
    for needles, p in (
        (("=",), rf'(?:(?<=[;"])|(?<=; ))\s*{_WORD}\s*=\s*([^;"¶\n\\]+?)\s*(?=;|")'),  # connection string
        (("¶", "\n", "\r", "\\n", "\\r"), rf'(?:(?<=¶)|(?<=\n)|(?<=\r)|(?<=\\n)|(?<=\\r))[ \t]*{_NAME}[ \t]*[=:][ \t]*([^¶\n\r\\"]+?)[ \t]*(?=¶|[\n\r"]|\\[nr])'),  # configuration line
        (("?", "&"), rf'[?&]{_NAME}=([^&"\'\s#]+)'),
        (("export",), rf'\bexport\s+{_NAME}=([^\s"\'$&;(]+)'),
        (("=",), rf'(?<=")\s*{_NAME}=([^\s"\'&;]+)(?=")'),
        ((("=", "'"),), rf"\b{_NAME}\s*=\s*'([^'\"<>]+)'"),
        (("identified",), r"\bidentified\s+by\s+'([^'\"]+)'"),
        ((("password", "'"),), r"\bpassword\s+'([^'\"]+)'"),
        (('\\"',), rf'\\"{_NAME}\\"\s*:\s*\\"((?:[^"\\]|\\(?!"))+)\\"'),
        ((('"', ":"),), rf'(?<!\\)"{_NAME}"\s*:\s*"((?:[^"\\]|\\.)+)"'),
        (("authorization:",), r"\bauthorization:\s*(?:bearer|basic|token|digest|apikey)\s+([^\s\"'\\¶]+)"),
        ((": ", ":\t"), r"(?<![\w-])(?!authorization)[\w-]*(?:key|token|secret|auth)[\w-]*:[ \t]+(?!bearer|basic)([^\s\"'\\¶;]+)(?=[\"'\\¶\s])"),
        (("-u", "--user"), r'(?<![\w-])(?:-u|--user)[ =]+[^\s:"]+:([^"]+?)(?=\s+-|\s*"|\\"|$)'),
        (("://",), r'[a-z][a-z0-9+.-]*://[^\s:/@"]+:([^\s"/]+)@[\w.-]+'),
        (("json",), rf'\[\s*"{_NAME}"\s*;\s*"((?:[^"\\]|\\.)+)"\s*;\s*JSON\w*'),
        (("~", "$"), rf'[~$]\w*{_NAME}\s*=\s*"((?:[^"\\]|\\.)+)"'),
        (("/*",), rf'/\*\s*{_WORD}\s*\*/\s*"((?:[^"\\]|\\.)+)"'),
        (("//",), rf'"((?:[^"\\]|\\.)+)"\s*\)*\s*//[ \t]*{_WORD}\b'),
        (("//",), rf'//[^"\n\r]*?\b(?:{_WORD}|login)\s+(?:is|was|ist|lautet|est|es|era|works with|mit)\s+([^\s"\]]+)'),
        (("hash.hmac",), r'\bHash\.HMAC"\s*;\s*"[^"]*"\s*;\s*"((?:[^"\\]|\\.)+)"'),
        (("cryptencrypt", "cryptdecrypt"), r'\bCrypt(?:En|De)crypt(?:Base64)?\s*\([^;"]*;\s*"((?:[^"\\]|\\.)+)"'),
        (("cryptauthcode",), r'\bCryptAuthCode\s*\([^;"]*;[^;]*;\s*"((?:[^"\\]|\\.)+)"'),
    )
)

#: One of these stands in every text that a pattern above can match, except for the prefixed tokens.
_TELLING = ("pass", "pwd", "pw", "kennwort", "mdp", "mot de", "contrase", "clave", "パスワ", "secret", "token", "credential", "key", "sig", "auth", "://", "-u", "identified", "login", "crypt", "hmac")

_LITERAL = r'"(?:[^"\\]|\\.)*"'
_CHAIN = re.compile(rf"{_LITERAL}(?:\s*&\s*{_LITERAL})+")
_PARTS = re.compile(r'"((?:[^"\\]|\\.)*)"')
_RANDOM = re.compile(r'"([A-Za-z0-9+/_-]{16,}={0,2})"')
_PASSWORD_STEP = re.compile(r"\bPassword:\s*(.*?)\s*\]\s*$", re.S)
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", _I)
_HEX = re.compile(r"[0-9a-f]{32,}", _I)

#: Forms of what stands in for a credential: nothing or a mask, a name in brackets, a variable, a constant.
_PLACEHOLDER = re.compile(r"[•●*·.xX#_\-…\s]*|<.*>|\[.*\]|\{+.*\}+|\$.*|%\w+%|.*…|(?:null|none|true|false|json(?:string)?)", _I | re.S)
#: Words by which a value calls itself a sample (a pattern of Spark's).
_SAMPLE = r"(?i)(?<![a-z])(?:sample|example|placeholder|dummy|changeme|your)(?![a-z])"
_REFERENCE = re.compile(r"\$|::|\b\w+\s*\(")


def _placeholder(v: str) -> bool:
    return _PLACEHOLDER.fullmatch(v) is not None


def _turns(v: str) -> int:
    """Changes between lower case, upper case and digits."""
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 for c in v if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def _random(v: str) -> bool:
    """Looks random: a long hexadecimal number, or often changing character classes."""
    if _UUID.fullmatch(v):
        return False
    if _HEX.fullmatch(v):
        return len(set(v.lower())) > 6
    return any(c.isdigit() for c in v) and _turns(v) >= max(6, len(v) // 4)


def expression(x: str) -> list[str]:
    """The literal credentials in what stands as a password: a literal, several joined ones, plain text, or a formula."""
    x = x.strip()
    if not x:
        return []
    if '"' in x:
        if re.fullmatch(rf"{_LITERAL}(?:\s*&\s*{_LITERAL})*", x):
            return _PARTS.findall(x)
        return re.findall(r'~?\w+\s*=\s*"((?:[^"\\]|\\.)*)"', x) + [p for c in _CHAIN.findall(x) for p in _PARTS.findall(c)]
    return [] if _REFERENCE.search(x) and not _strong(x) else [x]


def _strong(x: str) -> bool:
    """Plain text that only looks like a variable because a password holds a dollar sign."""
    return not re.search(r"::|\(|^\$|\s", x) and x.find("$") > 0


def _needles() -> ahocorasick.Automaton:
    """Finds in one pass which patterns a text can match: bit i for pattern i of ``_SELF``, the next bit for a telling word."""
    bits: dict[str, int] = {}
    for i, (_, needles, _) in enumerate(_SELF):
        for n in needles:
            bits[n] = bits.get(n, 0) | 1 << i
    for n in _TELLING:
        bits[n] = bits.get(n, 0) | 1 << len(_SELF)
    a = ahocorasick.Automaton()
    for n, b in bits.items():
        a.add_word(n, b)
    a.make_automaton()
    return a


_NEEDLES = _needles()


def _signs(low: str) -> int:
    out = 0
    for _, bit in _NEEDLES.iter(low):
        out |= bit
    return out


def _self_evident(text: str, signs: int) -> Iterator[tuple[str, str]]:
    for i, (kind, _, p) in enumerate(_SELF):
        if signs >> i & 1:
            for v in p.findall(text):
                yield v, kind


def literals(text: str, password: bool = False) -> list[tuple[str, str]]:
    """(value, kind) of everything in the text that may be a credential; ``password`` if the whole field is one."""
    return [x for x in candidates(text, password) if x[1] != MASKED]


def candidates(text: str, password: bool = False) -> list[tuple[str, str]]:
    """As ``literals``, with what only stands in for a value as kind ``MASKED``."""
    if not text:
        return []
    found: dict[str, str] = {}
    add = lambda v, kind: found.setdefault(v, MASKED if _placeholder(v) else kind)
    low = text.lower()
    signs = _signs(low)
    for v, kind in _self_evident(text, signs) if signs else ():
        add(v, kind)
    if password:
        for v in expression(text):
            add(v, NAMED)
        return list(found.items())
    if signs >> len(_SELF) & 1:
        for needles, p in _PLACED:
            if any(all(part in low for part in n) for n in needles):
                for v in p.findall(text):
                    if not ("::" in v and _REFERENCE.search(v)) and '" &' not in v:
                        add(v, NAMED)
    if "send mail" in low and (m := _PASSWORD_STEP.search(text)) is not None:
        for v in expression(m[1]):
            add(v, NAMED)
    for chain in _CHAIN.findall(text) if "&" in text else ():
        parts = _PARTS.findall(chain)
        if all(re.fullmatch(r"[A-Za-z0-9+/=_-]{4,}", p) for p in parts) and _turns("".join(parts)) >= 5:
            for v in parts:
                add(v, BARE)
    for v in _RANDOM.findall(text):
        if _random(v):
            add(v, BARE)
    keys = [v for v, k in found.items() if k == KEY]
    if keys:  # nothing inside a key block is a credential of its own
        found = {v: k for v, k in found.items() if k == KEY or not any(v in key for key in keys)}
    return list(found.items())


def spans(text: str, value: str) -> Iterator[tuple[int, int]]:
    """Where a value stands in a text on its own, not as part of a longer word."""
    at = text.find(value)
    while at >= 0:
        end = at + len(value)
        if _whole(text, at, end):
            yield at, end
        at = text.find(value, at + 1)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _begins(text: str, at: int) -> bool:
    return not (at > 0 and _word(text[at]) and _word(text[at - 1]) and text[max(0, at - 2) : at] not in ("\\n", "\\r", "\\t"))


def _ends(text: str, end: int) -> bool:
    return not (end < len(text) and _word(text[end - 1]) and _word(text[end]))


def _whole(text: str, at: int, end: int) -> bool:
    return _begins(text, at) and _ends(text, end)


def _wording(text: str, at: int, end: int) -> bool:
    """Plain words that are a whole comment: a remark that happens to read like a pass phrase."""
    return text[max(0, at - 3) : at] == "/* " and text[end : end + 3] == " */" and " " in text[at:end]


def masked(text: str | None, values: list[str], mask: str = MASK) -> str | None:
    """The text with every occurrence of the values masked; overlapping ones as one."""
    if not text or not values:
        return text
    places = sorted(s for v in values for s in spans(text, v))
    out, at = [], 0
    for a, z in places:
        if a < at:
            if z > at:
                at = z
            continue
        out += [text[at:a], mask]
        at = z
    return "".join(out) + text[at:]


# --- corpus -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """A text column; ``password`` if its whole content is a password."""

    column: str
    password: bool = False


def fields_of(df: DataFrame, tab: str, rec_id: str, owner: str, fields: list[Field]) -> DataFrame:
    """(tab, rec_id, owner, field, password, text), one row per field that has a text."""
    rows = F.array(*(F.struct(F.lit(f.column).alias("field"), F.lit(f.password).alias("password"), F.col(f.column).alias("text")) for f in fields))
    one = df.where(F.col(rec_id).isNotNull()).select(F.lit(tab).alias("tab"), F.col(rec_id).cast("long").alias("rec_id"), F.col(owner).alias("owner"), F.inline(rows))
    return one.where("length(text) > 0")


def _memo(password: bool, cache: dict) -> Callable[[str], list[tuple[str, str]]]:
    def get(text: str) -> list[tuple[str, str]]:
        k = (password, text)
        if k not in cache:
            if len(cache) > 20_000:
                cache.clear()
            cache[k] = candidates(text, password)
        return cache[k]

    return get


_RANKS = (MASKED, BARE, NAMED, TOKEN, KEY)


def literal_index(texts: DataFrame) -> DataFrame:
    """(value, kind, owners) of every literal of the corpus, kind the strongest one; in the row without a value the number of all owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        get = {p: _memo(p, cache) for p in (True, False)}
        for b in batches:
            owners = b.column(0).to_pylist()
            rows = {(v, _RANKS.index(k), o) for o, p, t in zip(owners, b.column(1).to_pylist(), b.column(2).to_pylist()) for v, k in get[p](t)} | {(None, 0, o) for o in set(owners)}
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["value", "rank", "owner"])

    seen = texts.select("owner", "password", "text").mapInArrow(run, "value string, rank int, owner string")
    by_owner = seen.groupBy("value", "owner").agg(F.max("rank").alias("rank"))
    n = by_owner.groupBy("value").agg(F.max("rank").alias("rank"), F.count("*").alias("owners"))
    return n.select("value", F.element_at(F.array(*map(F.lit, _RANKS)), F.col("rank") + 1).alias("kind"), "owners")


def judged(index: DataFrame, shared: int = SHARED_OWNERS, part: float = SHARED_PART) -> DataFrame:
    """The index with ``verdict``: confirmed, shared (a placeholder by its owners) or unstructured (a mask or stand-in of few owners)."""
    everyone = F.coalesce(index.where("value is null").agg(F.max("owners")).scalar(), F.lit(0))
    widely = F.col("owners") >= F.greatest(F.lit(shared), F.ceil(everyone * part))
    plain = (F.col("kind") == MASKED) | ~F.col("value").rlike(r"\d") | F.col("value").rlike(_SAMPLE)
    verdict = F.when(F.col("kind").isin(KEY, TOKEN), "confirmed").when(widely & plain, "shared").when(F.col("kind") == MASKED, "unstructured").otherwise("confirmed")
    return index.where("value is not null").withColumn("verdict", verdict)


def confirmed(index: DataFrame, shared: int = SHARED_OWNERS) -> DataFrame:
    return judged(index, shared).where("verdict = 'confirmed'").drop("verdict")


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))


def _hashes(values: DataFrame) -> DataFrame:
    """``h`` of the first ``LONG`` characters of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(np.array([_hash(v) for v in b.column(0).to_pylist()], np.uint64).view(np.int64))], ["h"])

    return values.select(F.substring("value", 1, LONG)).mapInArrow(run, "h long")


def upper_levels(values: DataFrame, chars: int = BLOCK_CHARS) -> tuple[int, list[tuple[str, int]]]:
    """(depth, leaves): the deepest level at which the trie of the values has no more than ``chars`` characters, and each leaf there
    with the lengths of the values below it as bits; bit ``LONG`` is any length from that on."""
    levels = values.agg(*(F.approx_count_distinct(F.substring("value", 1, d), 0.02).alias(str(d)) for d in range(1, DEPTH + 1))).first()
    depth = max((d for d in range(1, DEPTH + 1) if (levels[str(d)] or 0) * d <= chars), default=1)
    n = F.least(F.length("value"), F.lit(LONG))
    bit = lambda lo: F.when((n >= lo) & (n < lo + 60), F.call_function("shiftleft", F.lit(1).cast("bigint"), (n - lo).cast("int"))).otherwise(0)
    leaves = values.groupBy(F.substring("value", 1, depth).alias("leaf")).agg(*(F.bit_or(bit(lo)).alias(f"b{lo}") for lo in (0, 60, 120))).toArrow()
    return depth, [(x, a | b << 60 | c << 120) for x, a, b, c in zip(*(leaves[c].to_pylist() for c in ("leaf", "b0", "b60", "b120")))]


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, leaves: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """The automaton of the leaves; a Python worker keeps the last one for its next task."""
    if name not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        lengths: dict[int, tuple[int, ...]] = {}
        for leaf, bits in leaves:
            if bits not in lengths:
                lengths[bits] = tuple(i for i in range(LONG + 1) if bits >> i & 1)
            a.add_word(leaf, (len(leaf), lengths[bits]))
        a.make_automaton()
        _built[name] = a
    return _built[name]


_HITS = "tab string, rec_id long, field string, text_id string, start int, value string, rest string, sure boolean"


def _scan(texts: DataFrame, leaves: list[tuple[str, int]], words: np.ndarray) -> DataFrame:
    """Every place where a confirmed value may stand on its own: ``value`` is the text there, of long values the first ``LONG``
    characters and in ``rest`` all that follows; sure where a pattern recognises it anywhere. ``text_id`` names the text."""
    sc = texts.sparkSession.sparkContext
    sent = sc.broadcast((leaves, words))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, words = sent.value
        filled = bitmap.Map(words)
        automaton = _automaton(name, listed) if listed else None

        def find(text: str) -> list[tuple]:
            out: list[tuple] = []
            for last, (n, lengths) in automaton.iter(text) if automaton else ():
                at = last + 1 - n
                if not _begins(text, at):
                    continue
                for size in lengths:
                    end = at + size
                    if end > len(text):
                        break
                    if size < LONG and (not _ends(text, end) or _wording(text, at, end)):
                        continue
                    value = text[at:end]
                    if filled.passes_one(_hash(value)):
                        out.append((at, value, text[end:] if size == LONG else None, False))
            for v in {v for v, _ in _self_evident(text, _signs(text.lower())) if not _placeholder(v)}:
                out += [(at, v, None, True) for at, _ in spans(text, v)]
            text_id = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if out else ""
            return [(text_id, *x) for x in out]

        cache: dict[str, list] = {}
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_())
        names = ["tab", "rec_id", "field", "text_id", "start", "value", "rest", "sure"]
        for b in batches:
            rows: list[tuple] = []
            for tab, rec, field, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if text not in cache:
                    if len(cache) > 20_000:
                        cache.clear()
                    cache[text] = find(text)
                rows += [(tab, rec, field, *x) for x in cache[text]]
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return texts.select("tab", "rec_id", "field", "text").mapInArrow(run, _HITS)


def _settled(hits: DataFrame, values: DataFrame) -> DataFrame:
    """(tab, rec_id, field, text_id, start, secret): the hits that are confirmed values."""
    place = ["tab", "rec_id", "field", "text_id", "start"]
    sure = hits.where("sure").select(*place, F.col("value").alias("secret"))
    v = values.select(F.substring("value", 1, LONG).alias("_head"), F.col("value").alias("secret"))
    joined = hits.where("not sure").join(v, F.col("value") == F.col("_head"))
    over = F.substring("secret", F.lit(LONG + 1), F.greatest(F.length("secret") - LONG, F.lit(0)))
    after = F.substring("rest", F.length(over) + 1, F.lit(1))
    stops = ~(after.rlike(r"(?U)\w") & F.substring("secret", -1, 1).rlike(r"(?U)\w"))
    whole = F.col("rest").isNull() & (F.length("secret") < LONG) | (F.startswith("rest", over) & stops)
    return sure.unionByName(joined.where(whole).select(*place, "secret"))


def _own(found: DataFrame) -> DataFrame:
    """(tab, rec_id, field, secret), each once: a value within a longer one of the same text is not one of its own, unless it also
    stands alone. A place lies within a longer value if one that began no later ends no earlier."""
    end = F.col("start") + F.length("secret")
    places = found.distinct().withColumn("end", end)
    before = Window.partitionBy("tab", "rec_id", "field", "text_id").orderBy("start", F.desc("end"), "secret").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False))
    return places.withColumn("covered", covered).where("not covered").select("tab", "rec_id", "field", "secret").distinct()


def find_secrets(texts: DataFrame, shared: int = SHARED_OWNERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(tab, rec_id, field, secret) of every credential, each once per field."""
    index = cut(literal_index(texts))
    good = confirmed(index, shared).where(F.col("kind").isin(NAMED, BARE)).select("value")
    n = good.count()
    leaves = upper_levels(good, block_chars)[1] if n else []
    hits = cut(_scan(texts, leaves, bitmap.build(_hashes(good), n)))
    return _own(_settled(hits, good))


def redact(df: DataFrame, found: DataFrame, tab: str, rec_id: str, fields: list[Field], mask: str = MASK) -> DataFrame:
    """``df`` with the credentials of ``found`` masked in its text columns; rows without any pass through untouched."""
    values = found.where(F.col("tab") == tab).groupBy(F.col("rec_id").alias("_rec"), "field").agg(F.collect_list("secret").alias("v"))
    per = values.groupBy("_rec").agg(*(F.first(F.when(F.col("field") == f.column, F.col("v")), ignorenulls=True).alias(f"_v_{f.column}") for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for f in fields:
                v = cols.pop(f"_v_{f.column}")
                if v.null_count < len(v):
                    text = [masked(t, x, mask) if x else t for t, x in zip(cols[f.column].to_pylist(), v.to_pylist())]
                    cols[f.column] = pa.array(text, cols[f.column].type)
            cols.pop("_rec", None)
            yield pa.record_batch(list(cols.values()), list(cols))

    joined = df.join(per, F.col(rec_id) == F.col("_rec"), "left").drop("_rec")
    return joined.mapInArrow(run, df.schema)
