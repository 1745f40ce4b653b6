"""Secret scans with structural confirmation.

Three base kinds are plain patterns.  On top of them, long runs that could be
base64 or hex are decoded, and only what parses as a key or signed token is
reported.  A run that is no such thing as a whole is tried in parts (a token or
key within a path, a file name or a dotted name):

* ``jwt``: three base64url parts whose header is a JSON object with ``alg``;
* ``der``: base64 or hex of an ASN.1 sequence whose nested lengths fill it
  exactly and whose members are those of a private key (PKCS#1, PKCS#8, SEC 1, DSA);
* ``ssh``: base64 of an OpenSSH private key container, or of the wire format
  of a public key whose length fields fill it exactly;
* ``pem``: an armoured private key whose body, up to the next armour, decodes to
  one of the above or to an encrypted key; line ends may be written as ``\\n``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import fresh, joined_spans, text_udf

# Fixed patterns of the base kinds; a match that fails its check is dropped
# and the search goes on behind it.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Runs worth decoding; maximal, so that a text is read once.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{40,}")
#: Where a key's encoding can begin within a run, behind a character that is no letter or digit:
#: base64 of a DER sequence, of an SSH name's length, of the OpenSSH container.
ANCHOR = re.compile(r"(?<![A-Za-z0-9])(?:(?P<der>M[A-I])|(?P<ssh>AAAA[A-Z])|(?P<container>b3BlbnNzaC1rZXktdjEA))")
HEX_PART = re.compile(r"(?<![A-Za-z0-9])(?:30[0-9a-f]{38,}|30[0-9A-F]{38,})(?![A-Za-z0-9])")
SIGNATURE = re.compile(r"[A-Za-z0-9_-]+")
STOP = re.compile(r"[.=]")
#: Most members of a private key's sequence (PKCS#1 with more than two primes).
MEMBERS = 10
#: Length-prefixed fields of public keys; other ``ssh-`` names have the name and the key.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5}
PEM = re.compile(r"-----BEGIN ([A-Z0-9]+ )?PRIVATE KEY-----")
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "jwt", "der", "ssh", "pem"]
#: A line end within an armour that is written as a string.
ESCAPED_END = re.compile(r"\\+[nr]")
#: Object identifiers of password-based encryption (PKCS#5, PKCS#12; fixed values).
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: Bytes of a private number on an elliptic curve (fixed values).
CURVE_BYTES = (20, 24, 28, 32, 40, 48, 64, 66)


def _b64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1 or not run:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Decoded:
    """The bytes of base64 text, decoded where they are read: a key's lengths are
    followed without decoding its members."""

    def __init__(self, text: str, start: int, size: int):
        self.text, self.start, self.size = text, start, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key):
        if isinstance(key, int):
            return self[key : key + 1][0]
        at, end, _ = key.indices(self.size)
        first = at // 3
        got = self.text[self.start + 4 * first : self.start + min(-(-end // 3) * 4, -(-self.size * 4 // 3))]
        return (_b64(got) or b"")[at - 3 * first : end - 3 * first] if at < end else b""


def der_members(
    raw: bytes | Decoded, at: int = 0, end: int | None = None, most: int | None = None
) -> list[tuple[int, int, int]] | None:
    """(tag, first byte, end) of the ASN.1 values that fill ``raw[at:end]`` exactly; else None,
    also where there are more than ``most``."""
    end, out = len(raw) if end is None else end, []
    while at < end:
        if at + 2 > end or len(out) == most:
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(raw[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_private_der(raw: bytes | Decoded, most: int | None = None) -> bool:
    """A sequence of at most ``most`` members that holds a whole private key and nothing behind it."""
    if raw[:1] != b"\x30":
        return False
    top = der_members(raw, most=1)
    if not top or len(top) != 1:
        return False
    inner = der_members(raw, top[0][1], top[0][2], most)
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or raw[inner[0][1] : inner[0][2]] not in (b"\0", b"\1"):
        return False
    tags = [t for t, _, _ in inner]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # PKCS#1: nine integers
        return True
    if len(tags) == 6 and set(tags) == {0x02}:  # DSA: the prime and its divisor have their sizes
        prime, divisor = (b - a for _, a, b in inner[1:3])
        return prime >= 64 and 20 <= divisor <= 33
    if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # PKCS#8: algorithm, then the key
        algorithm = der_members(raw, *inner[1][1:], most)
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[1] == 0x04 and inner[1][2] - inner[1][1] in CURVE_BYTES  # SEC 1


def is_encrypted_der(raw: bytes) -> bool:
    """PKCS#8's encrypted form and nothing behind it: a password-based algorithm, then the ciphertext."""
    top = der_members(raw, most=1)
    if not top or top[0][0] != 0x30:
        return False
    inner = der_members(raw, *top[0][1:], 2)
    if not inner or [t for t, _, _ in inner] != [0x30, 0x04]:
        return False
    algorithm = der_members(raw, *inner[0][1:], 2)
    return bool(algorithm) and algorithm[0][0] == 0x06 and raw[algorithm[0][1] :].startswith(PASSWORD_BASED)


def is_armoured_key(body: str) -> bool:
    """Whether the text between an armour's lines holds a private key; header lines are
    skipped, and a body that they say is encrypted must be whole cipher blocks."""
    lines = ESCAPED_END.sub("\n", body).splitlines()
    headers = [x for x in lines if ":" in x]
    if len(lines) < 2:  # all in one line
        lines = body.split()
    raw = _b64("".join("".join(x.split()) for x in lines if ":" not in x))
    if not raw:
        return False
    if any(x.strip().startswith("DEK-Info:") for x in headers):
        return len(raw) % 8 == 0
    return is_private_der(raw) or is_encrypted_der(raw) or is_ssh_key(raw)


def is_ssh_key(raw: bytes) -> bool:
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    at, first = 0, None
    while at < len(raw):
        if at + 4 > len(raw):
            return False
        size = int.from_bytes(raw[at : at + 4], "big")
        if first is None:
            first = raw[at + 4 : at + 4 + size]
            if not first.startswith((b"ssh-", b"ecdsa-sha2-")):
                return False
        at += 4 + size
    return first is not None and at == len(raw)


def is_signed_token(run: str) -> bool:
    """header.payload.signature with a JSON header that names its algorithm."""
    parts = run.split(".")
    if len(parts) != 3 or not parts[1]:
        return False
    header = _b64(parts[0])
    if header is None or header[:1] != b"{" or _b64(parts[1]) is None:
        return False
    try:
        got = json.loads(header)
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and "alg" in got


def _whole(run: str) -> str | None:
    """``der`` or ``ssh`` if the run as a whole is one."""
    kinds = [_b64(run)]
    if not len(run) % 2 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        kinds.append(bytes.fromhex(run))
    for raw in kinds:
        if raw and is_private_der(raw):
            return "der"
        if raw and is_ssh_key(raw):
            return "ssh"
    return None


def _tokens(run: str) -> list[tuple[int, int]]:
    """Spans of the signed tokens among every three neighbouring dot parts of a run.

    The header is what follows the part's last separator of any one sort (or the
    whole part), the signature ends at the first character it cannot have."""
    parts, starts = run.split("."), [0]
    for p in parts:
        starts.append(starts[-1] + len(p) + 1)
    out, i = [], 0
    while i + 2 < len(parts):
        signature, i = SIGNATURE.match(parts[i + 2]), i + 1
        if not signature:
            continue
        head = parts[i - 1]
        for at in sorted({head.rstrip("=").rfind(c) + 1 for c in "/=+-_"} | {0}):
            if head[at : at + 1] == "e" and is_signed_token(f"{head[at:]}.{parts[i]}.{signature[0]}"):
                out.append((starts[i - 1] + at, starts[i + 1] + signature.end()))
                i += 2
                break
    return out


def _ends(run: str, at: int, size: int, stop: int) -> int | None:
    """Where base64 of ``size`` bytes from ``at`` on ends with its padding; None if it
    does not end at a separator or goes beyond ``stop``."""
    end = at + -(-size * 4 // 3)
    if end > stop or (end < len(run) and run[end].isalnum()):
        return None
    pad = -size % 3
    return end + pad if pad and run[end : end + pad] == "=" * pad else end


def _ssh_size(raw: Decoded) -> int | None:
    """Bytes of the SSH public key that ``raw`` begins with, by its length fields."""
    at, fields, n = 0, 1, 0
    while n < fields:
        if at + 4 > len(raw):
            return None
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return None
        if n == 0:
            name = raw[at + 4 : at + 4 + min(size, 64)]
            if size > 64 or not name.startswith((b"ssh-", b"ecdsa-sha2-")):
                return None
            fields = 3 if name.startswith(b"ecdsa") else SSH_FIELDS.get(name, 2)
        at, n = at + 4 + size, n + 1
    return at


def _container_size(raw: Decoded) -> int | None:
    """Bytes of the OpenSSH container: cipher, kdf, its options, a number of public keys, the private part."""
    at, left = 15, 3
    for phase in range(2):
        while left:
            if at + 4 > len(raw):
                return None
            at, left = at + 4 + int.from_bytes(raw[at : at + 4], "big"), left - 1
        if phase == 0:
            if at + 4 > len(raw):
                return None
            left, at = int.from_bytes(raw[at : at + 4], "big") + 1, at + 4
            if left > MEMBERS:
                return None
    return at if at <= len(raw) else None


def _keys(run: str) -> list[tuple[str, int, int]]:
    """Keys that begin at an anchor of a run and end where their length fields say."""
    out, after, stop = [], 0, -1
    for m in ANCHOR.finditer(run):
        at = m.start()
        if at < after:
            continue
        if at >= stop:  # '.' and '=' are no part of an encoding
            found = STOP.search(run, at)
            stop = found.start() if found else len(run)
        n = (stop - at) * 3 // 4
        raw, end = Decoded(run, at, n), None
        if m["der"]:
            head = raw[:6]
            more = head[1] & 0x7F if len(head) == 6 and head[1] & 0x80 else 0
            if len(head) < 6 or more > 4 or head[1] == 0x80:
                continue
            size = 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
            end = _ends(run, at, size, stop) if size <= n else None
            if end is None or not is_private_der(Decoded(run, at, size), MEMBERS):
                continue
        else:
            size = _ssh_size(raw) if m["ssh"] else _container_size(raw)
            end = _ends(run, at, size, stop) if size else None
            if end is None and m["container"]:
                end = stop  # the name alone confirms it
            if end is None:
                continue
        out.append(("der" if m["der"] else "ssh", at, end))
        after = end
    for m in HEX_PART.finditer(run):
        if not len(m[0]) % 2 and is_private_der(bytes.fromhex(m[0])):
            out.append(("der", *m.span()))
    return out


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded bytes are a key or a signed token."""
    out = []
    for m in RUN.finditer(text):
        # an assignment's name in front of the value belongs to the run
        at, run = m.start(), m[0].rstrip(".")
        skip = run.rstrip("=").rfind("=") + 1
        whole = None
        if len(run) - skip >= 40 and "." not in run[skip:]:
            whole = _whole(run[skip:])
        if whole:
            out.append((whole, at + skip, at + len(run)))
            run = run[:skip]
        tokens = _tokens(run)
        out += [("jwt", at + s, at + e) for s, e in tokens]
        for kind, s, e in _keys(run):
            if not any(a < e and s < b for a, b in tokens):
                out.append((kind, at + s, at + e))
    begins = list(PEM.finditer(text))
    for m, limit in zip(begins, [*(n.start() for n in begins[1:]), len(text)]):
        close = f"-----END {m[1] or ''}PRIVATE KEY-----"
        end = text.find(close, m.end(), limit)
        if end >= 0 and is_armoured_key(text[m.end() : end]):
            out.append(("pem", m.start(), end + len(close)))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]


def secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind; ends are exclusive code points."""
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base_spans(text) + confirmed(text), key=lambda s: (s[1], order[s[0]], s[2]))


SPAN = "struct<kind:string,start:int,end:int>"


def spans_column(text: Column) -> Column:
    """``array<struct<kind,start,end>>`` of a text column; null texts have none."""

    def make():
        return lambda t: [{"kind": k, "start": s, "end": e} for k, s, e in secrets(t)]

    return text_udf(f"array<{SPAN}>", make)(text)


def redact(text: str) -> str:
    """The text with every secret replaced by ``[secret]``; overlapping spans give one mark."""
    out, at = [], 0
    for _, s, e in secrets(text):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs(doc_id, text)``; other columns are ignored,
    null and empty texts have no spans, repeated rows each give a row."""
    return docs.select("doc_id", spans_column(F.col("text")).alias("spans"))


def secret_digests(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text`` masked and ``n_chars``
    set to the new length where that changed the text (a null text stays null)."""
    (masked,) = fresh(docs, "masked")
    out = docs.withColumn(masked, text_udf("string", lambda: redact)(F.col("text")))
    changed = F.col("text").isNotNull() & (F.col(masked) != F.col("text"))
    new = {"text": F.when(changed, F.col(masked)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(masked).cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
