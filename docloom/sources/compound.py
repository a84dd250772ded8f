"""Outlook messages (S12): compound files, their sectors, chains and directory tree."""

from __future__ import annotations

import datetime
import struct

from ..functions.markup import Outline

SIGNATURE, END, FREE = bytes.fromhex("D0CF11E0A1B11AE1"), 0xFFFFFFFE, 0xFFFFFFFF


class Compound:
    """Streams of a compound file by their paths."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != SIGNATURE or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        self.size, self.mini_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        if not 64 <= self.size <= 1 << 20 or not 1 <= self.mini_size <= self.size:
            raise ValueError("sector size")
        directory, _, self.cutoff, mini, _, more, _ = struct.unpack_from("<I4sIIIII", data, 48)
        tables = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while more not in (END, FREE) and more not in seen:  # further lists of the table's sectors
            seen.add(more)
            entries = struct.unpack(f"<{self.size // 4}I", self.sector(more))
            tables, more = tables + list(entries[:-1]), entries[-1]
        self.table = self.numbers(b"".join(self.sector(s) for s in tables if s not in (FREE, END)))
        self.mini_table = self.numbers(self.chain(mini))
        entries = self.chain(directory)
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        if not self.entries:
            raise ValueError("no directory")
        root_start, root_size = struct.unpack_from("<IQ", self.entries[0], 116)
        self.mini = self.chain(root_start)[:root_size]
        self.streams: dict[str, bytes] = {}
        self.walk(struct.unpack_from("<I", self.entries[0], 76)[0], "", set())

    def sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at >= len(self.data):
            raise ValueError("sector beyond the end")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    @staticmethod
    def numbers(data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])

    def chain(self, start: int) -> bytes:
        """The sectors from one on, as the table links them."""
        out, seen = [], set()
        while start not in (END, FREE):
            if start in seen or start >= len(self.table):
                raise ValueError("broken chain")
            seen.add(start)
            out.append(self.sector(start))
            start = self.table[start]
        return b"".join(out)

    def mini_chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start not in (END, FREE):
            if start in seen or start >= len(self.mini_table):
                raise ValueError("broken chain")
            seen.add(start)
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini_table[start]
        return b"".join(out)

    def walk(self, at: int, path: str, seen: set[int]) -> None:
        """The streams of a directory's tree of siblings, and of the directories in it."""
        open_ = [(at, path)]
        while open_:
            at, path = open_.pop()
            if at >= len(self.entries) or at in seen:
                continue
            seen.add(at)
            entry = self.entries[at]
            length, kind = struct.unpack_from("<HB", entry, 64)
            left, right, below = struct.unpack_from("<III", entry, 68)
            name = path + entry[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            open_ += [(left, path), (right, path)]
            if kind == 2:
                start, size = struct.unpack_from("<IQ", entry, 116)
                size &= 0xFFFFFFFF if self.size == 512 else 0xFFFFFFFFFFFFFFFF
                self.streams[name] = (self.mini_chain(start) if size < self.cutoff else self.chain(start))[:size]
            elif kind == 1:
                open_.append((below, name + "/"))


# Numbers of a message's properties.
SUBJECT, BODY, HTML, SENDER_NAME, SENDER_MAIL, SENDER_SMTP, SENT, PAGE = "0037", "1000", "1013", "0C1A", "0C1F", "5D01", 0x00390040, 0x3FFD0003


def msg_text(content: bytes) -> str:
    """Subject, sender and date lines, then the body (or the HTML body without tags); ValueError if it can't be read."""
    try:
        streams = Compound(content).streams
    except struct.error as error:
        raise ValueError(str(error)) from error
    table = streams.get("__properties_version1.0", b"")
    fixed = {struct.unpack_from("<I", table, at)[0]: table[at + 8 : at + 16] for at in range(32, len(table) - 15, 16)}
    page = f"cp{struct.unpack('<I', fixed[PAGE][:4])[0]}" if PAGE in fixed else "cp1252"
    page = "utf-8" if page == "cp65001" else page

    def text(number: str) -> str | None:
        wide, narrow = (streams.get(f"__substg1.0_{number}{kind}") for kind in ("001F", "001E"))
        if wide is not None:
            return wide.decode("utf-16-le", "replace").rstrip("\0")
        try:
            return narrow.decode(page, "replace").rstrip("\0") if narrow is not None else None
        except LookupError:
            return narrow.decode("cp1252", "replace").rstrip("\0")

    body, html = text(BODY), text(HTML) or streams.get(f"__substg1.0_{HTML}0102", b"").decode("utf-8", "replace")
    if body is None and html:
        body = " ".join(Outline(html).visible)
    name, mail = text(SENDER_NAME), text(SENDER_SMTP) or text(SENDER_MAIL)
    sender = f"{name} <{mail}>" if name and mail and name != mail else name or mail or ""
    ticks = struct.unpack("<Q", fixed[SENT])[0] if SENT in fixed else None
    date = (datetime.datetime(1601, 1, 1) + datetime.timedelta(microseconds=min(ticks // 10, 10**17))).isoformat(sep=" ", timespec="seconds") if ticks else ""
    return "\n".join([f"Subject: {text(SUBJECT) or ''}", f"From: {sender}", f"Date: {date}", "", (body or "").replace("\r\n", "\n").strip()])
