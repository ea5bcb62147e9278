"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty of strings in sensitive context."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship

KINDS = ("assign", "access", "hex", "novel")
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Words whose neighbourhood is sensitive.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "authorization", "bearer", "private_key", "access_key", "client_id", "signature")
CONTEXT = re.compile("|".join(re.escape(x) for x in CONTEXT_WORDS), re.A | re.I)
CONTEXT_BYTES = tuple(x.encode() for x in CONTEXT_WORDS)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: How far after a sensitive word a candidate may start, and how much code around a candidate primes the compressor.
REACH, AROUND = 48, 256
#: zstandard codes literals by entropy from 64 bytes on, so longer candidates are measured in pieces, each primed with what lies behind it.
PIECE, BEHIND = 63, 2048

#: The identifier dictionary: what code around secrets repeats. Not sensitive by itself, so it must compress away.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key client_id client_secret private_key public_key authorization bearer "
    "credential signature example placeholder changeme your_password_here your_api_key_here environment configuration "
    "default username hostname localhost endpoint database connection application version string const export import return "
    "function public static final class config settings process.env os.environ getenv http https example.com "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx"
).encode()


class Novelty:
    """Marginal bytes of a string: its zstandard size, primed with identifiers and the code around it, less that of nothing."""

    def __init__(self, level: int = 3):
        import zstandard

        self.z, self.level = zstandard, level

    def __call__(self, candidate: bytes, around: bytes) -> int:
        step = -(-len(candidate) // max(1, -(-len(candidate) // PIECE)))
        return sum(self.piece(candidate[i : i + step], around + candidate[max(0, i - BEHIND) : i]) for i in range(0, len(candidate), step or 1))

    def piece(self, candidate: bytes, around: bytes) -> int:
        primed = self.z.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        c = self.z.ZstdCompressor(level=self.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(candidate)) - len(c.compress(b""))


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; low is the text in UTF-8 with A-Z lowered."""
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, low: bytes, novelty: Novelty, ratio: float) -> list[tuple[int, int, int]]:
    """All strings of 16+ characters with letters and digits that start soon after a sensitive word, on its line or a later one, and keep ratio of their bytes."""
    if not any(w in low for w in CONTEXT_BYTES):
        return []
    out, done = [], 0
    for word in CONTEXT.finditer(text):
        at, last = max(done, word.end()), word.end() + REACH
        while (m := CANDIDATE.search(text, at, last + 16)) and m.start() <= last:
            m = CANDIDATE.match(text, m.start())
            s = m.group()
            done = at = m.end()
            if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                continue
            around = text[max(0, m.start() - AROUND) : m.start()] + "\n" + text[m.end() : m.end() + AROUND]
            if novelty(s.encode(), around.encode()) >= ratio * len(s):
                out.append((m.start(), 3, m.end()))
    return out


def scan(text: str | None, novelty: Novelty, ratio: float = 0.9):
    """Base spans and all spans of one text, each as a sorted list of (start, kind, end)."""
    text = text or ""
    low = text.encode("utf-8", "surrogatepass").lower()
    base = base_spans(text, low)
    return base, sorted(base + novel_spans(text, low, novelty, ratio))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", ratio: float = 0.9) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_novel), a row for each row of docs.

    Null and empty texts have no spans. Repeated rows give repeated results; an empty table gives no rows. Only the id
    and the text are read. Nothing is shuffled: each text is scanned whole where it lies, so no key can be hot.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        novelty = Novelty()
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                base, spans = scan(t, novelty, ratio)
                n = [sum(k == x for _, k, _ in spans) for x in range(4)]
                for c, v in zip(cols, (*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3])):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return docs.select(id_col, F.col(text).alias("__text")).mapInArrow(run, f"{id_col} {kind.simpleString()}, {SCHEMA}")


def op1(docs: DataFrame) -> DataFrame:
    return find_secrets(docs)
