"""Text of uploaded files: txt, docx and pdf. Also a program that extracts files under limits.

``python -m quillspark.sources.extraction NAME`` reads the file from standard input and writes the document
as JSON. Without a name it takes one file after another, each with limits of its own, until its input ends;
see :class:`Parser`. It needs nothing of Spark, so that starting it is cheap.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import re
import select
import struct
import subprocess
import sys
import time
import zipfile
from xml.etree import ElementTree

#: First lines over this many characters are no title.
MAX_TITLE = 200
MAX_FILE, MAX_XML = 10 << 20, 50 << 20
# White space that ends of texts and titles lose.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Memory and CPU seconds of an extraction, and the seconds it may take in all.
MEMORY, CPU_SECONDS, WALL_SECONDS = 1 << 30, 60, 30
#: A process that parses file after file ends when its address space has grown by so much, and after so many files.
GROWN, FILES = 64 << 20, 2000
_MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "p": "\n"}


def split_name(path: str) -> tuple[str, str]:
    """(stem, extension) of an uploaded file's name; raises ValueError without either."""
    name = re.split(r"[/\\]", path)[-1].strip()
    stem, dot, ext = name.rpartition(".")
    if not dot or not stem.strip():
        raise ValueError(f"file name has no stem or extension: {name}")
    return stem.strip(), ext.lower()


def docx_text(data: bytes) -> str:
    """Text of a docx: runs of text, a line for each paragraph or break, tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo("word/document.xml").file_size > MAX_XML:
            raise ValueError("document is too large")
        out: list[str] = []
        for _, el in ElementTree.iterparse(io.BytesIO(z.read("word/document.xml"))):
            tag = el.tag.rpartition("}")[2]
            out.append((el.text or "") if tag == "t" else _MARKS.get(tag, ""))
        return "".join(out)


def clean_pdf_text(text: str) -> str:
    """Trimmed lines; runs of blank lines become one, those at the beginning go."""
    out: list[str] = []
    blank = False
    for line in (x.strip(WHITE) for x in text.split("\n")):
        if not line:
            blank = bool(out)
            continue
        out += [""] * blank + [line]
        blank = False
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    try:
        import pypdf
    except ImportError:
        raise ValueError("pdf files need the pypdf package") from None
    return clean_pdf_text("\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages))


def extract(path: str, data: bytes) -> dict:
    """A file as a document, or the reason why not."""
    try:
        stem, ext = split_name(path)
        if len(data) > MAX_FILE:
            raise ValueError("file is too large")
        if ext == "txt":
            text = data.decode("utf-8").removeprefix("﻿")
        elif ext in ("docx", "pdf"):
            text = docx_text(data) if ext == "docx" else pdf_text(data)
        else:
            raise ValueError(f"unsupported format: {ext}")
        text = text.strip(WHITE)
        if not text:
            raise ValueError("no text in the file, maybe a scan" if ext == "pdf" else "the file is empty")
        first, _, rest = text.partition("\n")
        first = first.strip(WHITE)
        title, body = (stem, text) if len(first) > MAX_TITLE else (first, rest.strip(WHITE))
        return {"id": stem, "title": title, "body": body, "format": ext, "size": len(data), "error": None}
    except UnicodeDecodeError:
        return {"error": "the text is not UTF-8"}
    except Exception as e:  # noqa: BLE001  a broken file is a value, not a failed task
        return {"error": str(e) or type(e).__name__}


def _parsed(path: str, data: bytes) -> bool:
    """Does a file need a parser, and so a process of its own?"""
    return path.rpartition(".")[2].strip().lower() in ("docx", "pdf") and len(data) <= MAX_FILE


def _program(memory: int, cpu: int) -> dict:
    """How the program is started; it has the paths of this process."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in sys.path if x), "EXTRACT_LIMITS": f"{memory},{cpu}"}
    return {"args": [sys.executable, "-m", "quillspark.sources.extraction"], "env": env}


def extract_limited(path: str, data: bytes, memory: int = MEMORY, cpu: int = CPU_SECONDS, wall: float = WALL_SECONDS) -> dict:
    """:func:`extract` in a process of its own for formats that need a parser; what goes beyond the limits is an error value."""
    if not _parsed(path, data):
        return extract(path, data)
    program = _program(memory, cpu)
    try:
        done = subprocess.run(
            [*program["args"], path],
            input=data,
            capture_output=True,
            timeout=wall,
            env=program["env"],
            check=False,
        )
        return json.loads(done.stdout) if done.returncode == 0 else {"error": "extraction crashed"}
    except subprocess.TimeoutExpired:
        return {"error": "extraction took too long"}
    except ValueError:
        return {"error": "extraction crashed"}


class Parser:
    """:func:`extract_limited` for many files: one process parses file after file, so that a start isn't paid for each.

    Every file has the same limits as alone: the memory above what the process holds, the CPU seconds above
    what it has used, and the wall time. What doesn't come out as a document is tried again in a process of
    its own, unless it is an error that no other file can have had a part in; so only that one's word counts.
    """

    def __init__(self, memory: int = MEMORY, cpu: int = CPU_SECONDS, wall: float = WALL_SECONDS):
        self.memory, self.cpu, self.wall = memory, cpu, wall
        self.process: subprocess.Popen | None = None
        self.started = 0

    def __enter__(self) -> Parser:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.process:
            self.process.kill()
            for pipe in (self.process.stdin, self.process.stdout):
                with contextlib.suppress(OSError):
                    pipe.close()
            self.process.wait()
            self.process = None

    def extract(self, path: str, data: bytes) -> dict:
        if not _parsed(path, data):
            return extract(path, data)
        if self.process is None:
            program = _program(self.memory, self.cpu)
            self.process = subprocess.Popen(**program, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=0)
            self.started += 1
        try:
            got, more = self._answer(path, data)
        except TimeoutError:
            self.close()
            return {"error": "extraction took too long"}
        except (OSError, EOFError, ValueError):
            self.close()
            return extract_limited(path, data, self.memory, self.cpu, self.wall)
        if not more:
            self.close()
        return got if got is not None else extract_limited(path, data, self.memory, self.cpu, self.wall)

    def _answer(self, path: str, data: bytes) -> tuple[dict | None, bool]:
        """(the document or null, does the process take another file)."""
        until = time.monotonic() + self.wall
        name = path.encode("utf-8", "surrogatepass")
        rest = memoryview(struct.pack("<II", len(name), len(data)) + name + data)
        os.set_blocking(self.process.stdin.fileno(), False)
        while rest:
            self._wait([], [self.process.stdin], until)
            rest = rest[self.process.stdin.write(rest) or 0 :]
        size, more = struct.unpack("<I?", self._read(5, until))
        return json.loads(self._read(size, until)), more

    def _read(self, size: int, until: float) -> bytes:
        out = bytearray()
        while len(out) < size:
            self._wait([self.process.stdout], [], until)
            part = os.read(self.process.stdout.fileno(), min(size - len(out), 1 << 20))
            if not part:
                raise EOFError
            out += part
        return bytes(out)

    @staticmethod
    def _wait(read: list, write: list, until: float) -> None:
        found = select.poll()
        for pipe, what in [*((x, select.POLLIN) for x in read), *((x, select.POLLOUT) for x in write)]:
            found.register(pipe, what)
        if not found.poll(max(0.0, until - time.monotonic()) * 1000):
            raise TimeoutError


def _sure(got: dict) -> bool:
    """A document, or an error by which the file's own content is judged: memory that runs out has other words."""
    return got["error"] is None or got["error"] in ("the file is empty", "document is too large", "File is not a zip file")


def _address_space() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[0]) * os.sysconf("SC_PAGE_SIZE")


def serve(memory: int, cpu: int) -> None:
    """Files from standard input, answers to standard output; a file's limits start from what the process has taken by then."""
    import gc
    import resource

    began = _address_space()
    source, sink = sys.stdin.buffer, sys.stdout.buffer
    for n in range(1, FILES + 1):
        head = source.read(8)
        if len(head) < 8:
            return
        name, size = struct.unpack("<II", head)
        path, data = source.read(name).decode("utf-8", "surrogatepass"), source.read(size)
        used = resource.getrusage(resource.RUSAGE_SELF)
        for what, most in (
            (resource.RLIMIT_AS, memory + _address_space() - began),
            (resource.RLIMIT_CPU, cpu + round(used.ru_utime + used.ru_stime)),
        ):
            resource.setrlimit(what, (most, resource.getrlimit(what)[1]))
        got = extract(path, data)
        del data
        more = n < FILES
        if more and _address_space() - began > GROWN:
            gc.collect()
            more = _address_space() - began <= GROWN
        answer = json.dumps(got if _sure(got) else None).encode()
        sink.write(struct.pack("<I?", len(answer), more) + answer)
        sink.flush()
        if not more:
            return


def main() -> None:
    import resource

    memory, cpu = map(int, os.environ["EXTRACT_LIMITS"].split(","))
    if not sys.argv[1:]:
        return serve(memory, cpu)
    for what, most in ((resource.RLIMIT_AS, memory), (resource.RLIMIT_CPU, cpu)):
        resource.setrlimit(what, (most, most))
    json.dump(extract(sys.argv[1], sys.stdin.buffer.read(MAX_FILE + 1)), sys.stdout)


if __name__ == "__main__":
    main()
