"""Text of MOBI, AZW and AZW3 e-books: Palm databases with plain or LZ77-compressed HTML records."""

from __future__ import annotations

import re
import struct

TAG = re.compile("<[^>]+>")
BREAK = re.compile(r"(?i)</?(?:p|div|br|h[1-6]|li|tr|blockquote|mbp:pagebreak)\b[^>]*>")


def unpack(data: bytes) -> bytes:
    """LZ77 as Palm documents have it."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c == 0 or 9 <= c < 0x80:
            out.append(c)
        elif c < 9:
            out += data[i : i + c]
            i += c
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        else:
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            for _ in range((pair & 7) + 3):
                out.append(out[-(pair >> 3)])
    return bytes(out)


def _trailing(record: bytes, flags: int) -> int:
    """Bytes after a record's text."""
    end = len(record)
    for bit in range(15, 0, -1):
        if flags >> bit & 1:
            size = shift = 0
            for k in range(1, 5):
                b = record[end - k]
                size |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            end -= size
    if flags & 1:
        end -= (record[end - 1] & 3) + 1
    return len(record) - end


def html_of(content: bytes) -> tuple[str, str]:
    """(title, HTML) of a book; a compression other than none and LZ77 is an error."""
    n = struct.unpack_from(">H", content, 76)[0]
    starts = [struct.unpack_from(">I", content, 78 + 8 * k)[0] for k in range(n)] + [len(content)]
    head = content[starts[0] : starts[1]]
    compression, _, _, count = struct.unpack_from(">HHIH", head)
    if compression not in (1, 2):
        raise ValueError(f"compression {compression} isn't supported")
    title, encoding, flags = content[:32].split(b"\0", 1)[0].decode("latin-1"), "cp1252", 0
    if head[16:20] == b"MOBI":
        size, code = struct.unpack_from(">I", head, 20)[0], struct.unpack_from(">I", head, 28)[0]
        encoding = "utf-8" if code == 65001 else "cp1252"
        if len(head) >= 92:
            at, length = struct.unpack_from(">II", head, 84)
            title = head[at : at + length].decode(encoding, "replace") or title
        if size >= 228 and len(head) >= 244:
            flags = struct.unpack_from(">H", head, 242)[0]
    text = b""
    for k in range(1, min(count, n - 1) + 1):
        record = content[starts[k] : starts[k + 1]]
        record = record[: len(record) - _trailing(record, flags)]
        text += unpack(record) if compression == 2 else record
    return title, text.decode(encoding, "replace")


def blocks(content: bytes) -> tuple[str, list[str]]:
    """(title, blocks of text between breaks)."""
    title, html = html_of(content)
    text = TAG.sub(" ", BREAK.sub("\n\n", html))
    return title, [" ".join(b.split()) for b in re.split(r"\n\s*\n", text) if b.strip()]
