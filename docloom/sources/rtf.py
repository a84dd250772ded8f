"""RTF text (S11): an automaton over groups, with skipped destinations, code pages and Unicode with its fallback."""

from __future__ import annotations

import re

TOKEN = re.compile(r"\\(?:'([0-9A-Fa-f]{2})|([A-Za-z]{1,40})(-?\d{1,10})? ?|(\r\n|.|\n))|([{}])|([^\\{}\r\n]+)|[\r\n]", re.S)

# Groups whose text isn't the document's.
SKIPPED = {
    "fonttbl", "colortbl", "stylesheet", "listtable", "listoverridetable", "filetbl", "revtbl", "rsidtbl", "xmlnstbl", "themedata", "colorschememapping", "latentstyles", "datastore", "generator", "info", "pict", "objdata",
    "header", "headerl", "headerr", "headerf", "footer", "footerl", "footerr", "footerf", "footnote", "annotation", "fldinst", "bkmkstart", "bkmkend", "nonshppict", "datafield", "formfield", "xe", "tc", "pntext",
}
# Words that stand for characters.
CHARACTERS = {
    "par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "|", "emdash": "—", "endash": "–", "emspace": "\u2003", "enspace": "\u2002", "qmspace": "\u2005", "bullet": "•",
    "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "zwj": "\u200d", "zwnj": "\u200c",
}
# Signs after a backslash.
SIGNS = {"~": "\xa0", "_": "\u2011", "-": "", "\\": "\\", "{": "{", "}": "}", "\n": "\n", "\r": "\n", "\r\n": "\n", "\t": "\t"}
# Code pages by a font's character set.
CHARSETS = {0: "cp1252", 77: "mac_roman", 128: "cp932", 129: "cp949", 130: "johab", 134: "gbk", 136: "cp950", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}
PAGES = {"mac": "mac_roman", "pc": "cp437", "pca": "cp850", "ansi": "cp1252"}


def codec(name: str) -> str:
    try:
        return "utf-8" if name == "cp65001" else name if "".encode(name) == b"" else "cp1252"
    except LookupError:
        return "cp1252"


def rtf_text(content: bytes) -> str:
    """The document's text; ValueError if the bytes aren't RTF. Groups that aren't closed end with the file."""
    if not content.lstrip()[:5] == b"{\\rtf":
        raise ValueError("no RTF")
    raw = content.decode("latin-1")
    out: list[str] = []
    held, page, charsets = bytearray(), "cp1252", {}  # bytes that wait for their neighbours, the file's code page, fonts' ones
    group, stack = {"skip": False, "uc": 1, "font": None, "table": False}, []
    fallback, high, fresh, at = 0, None, False, 0

    def flush() -> None:
        if held:
            out.append(held.decode(charsets.get(group["font"], page), "replace"))
            held.clear()

    def say(text: str) -> None:
        nonlocal high
        flush()
        if high is not None:
            out.append("\ufffd")
            high = None
        out.append(text)

    while at < len(raw):
        m = TOKEN.match(raw, at)
        if m is None:  # a backslash at the end
            break
        at = m.end()
        byte, word, number, sign, brace, text = m.groups()
        if brace == "{":
            flush()
            stack.append(dict(group))
            fresh, fallback = True, 0
            continue
        if brace == "}":
            flush()
            if not stack:
                break
            group, fallback, fresh = stack.pop(), 0, False
            if not stack:
                break
            continue
        if word is not None:
            value = int(number) if number else None
            if word == "bin":
                at += max(0, value or 0)
            elif word == "u" and value is not None:
                fallback = group["uc"]
                if not group["skip"]:
                    code = value % 65536
                    if 0xD800 <= code < 0xDC00:
                        flush()
                        high = code
                    elif 0xDC00 <= code < 0xE000:
                        pair, high = (chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00) if high is not None else "\ufffd"), None
                        say(pair)
                    else:
                        say(chr(code))
            elif fallback:
                fallback -= 1
            elif word == "uc":
                group["uc"] = max(0, value or 0)
            elif word in PAGES and len(stack) == 1:
                page = PAGES[word]
            elif word == "ansicpg" and value:
                page = codec(f"cp{value}")
            elif word == "f":
                flush()
                group["font"] = value
            elif word == "fcharset" and group["table"]:
                charsets[group["font"]] = codec(CHARSETS.get(value, page))
            elif word in SKIPPED and (fresh or word == "fonttbl"):
                flush()
                group["skip"], group["table"] = True, word == "fonttbl"
            elif word in CHARACTERS and not group["skip"]:
                say(CHARACTERS[word])
            elif word in ("plain", "pard"):
                flush()
            fresh = False
            continue
        if sign == "*" and fresh:
            flush()
            group["skip"] = True
            continue
        fresh = False
        if byte is not None or sign is not None:
            if fallback:
                fallback -= 1
            elif not group["skip"]:
                if byte is not None:
                    held.append(int(byte, 16))
                else:
                    say(SIGNS.get(sign, ""))
        elif text is not None:
            text, fallback = text[fallback:], max(0, fallback - len(text))
            if text and not group["skip"]:
                if high is not None:
                    say("")
                held.extend(text.encode("latin-1"))
    flush()
    return "".join(out).strip(" \t\r\n")


def rtf_bytes(text: str) -> bytes:
    """A file with the text: accents as bytes of the code page, what it lacks as Unicode numbers with a fallback."""
    said = []
    for c in text:
        if c == "\n":
            said.append("\\par\n")
        elif c in "\\{}":
            said.append("\\" + c)
        elif " " <= c <= "~":
            said.append(c)
        else:
            try:
                said.append("".join(f"\\'{b:02x}" for b in c.encode("cp1252")))
            except UnicodeEncodeError:
                units = c.encode("utf-16-be", "surrogatepass")
                said.append("".join(f"\\u{n - 65536 if n > 32767 else n}?" for n in (int.from_bytes(units[i : i + 2]) for i in range(0, len(units), 2))))
    head = "{\\rtf1\\ansi\\ansicpg1252\\uc1{\\fonttbl{\\f0\\froman\\fcharset0 Times New Roman;}}{\\colortbl;\\red0;}{\\*\\generator Made;}{\\info{\\author Nobody}}\\f0\\pard "
    return (head + "".join(said) + "\\par}").encode("ascii")
