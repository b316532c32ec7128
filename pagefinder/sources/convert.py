"""Old Word files as .docx by an office program on the workers; off unless it is passed to a reader."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

# Fixed values.
PROGRAMS, SECONDS = ("soffice", "libreoffice"), 60


def office_converter(content: bytes) -> bytes | None:
    """The .docx that the program makes of a .doc; None without a program, or if it fails or takes too long.

    The folder it works in belongs to this call alone and goes with it; nothing in it is read by another task.
    """
    program = next(filter(None, map(shutil.which, PROGRAMS)), None)
    if program is None:
        return None
    with tempfile.TemporaryDirectory() as scratch:
        given, made = Path(scratch, "in.doc"), Path(scratch, "out", "in.docx")
        given.write_bytes(content)
        profile = f"-env:UserInstallation=file://{scratch}/profile"  # so that tasks don't wait for each other's lock
        try:
            subprocess.run([program, profile, "--headless", "--convert-to", "docx", "--outdir", str(made.parent), str(given)], timeout=SECONDS, check=True, capture_output=True)
        except (subprocess.SubprocessError, OSError):
            return None
        return made.read_bytes() if made.exists() else None
