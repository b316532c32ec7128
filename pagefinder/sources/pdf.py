"""PDF by PyMuPDF, where it is installed: a reader for ``read_pages`` and an opener for OCR.

The library is imported by the worker when the first file is opened, so everything else works without it.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np

from ..functions.image import deskew

#: (RGB image) -> [(text, confidence)] a line.
ImageOcr = Callable[[np.ndarray], list[tuple[str, float]]]


def read_pdf(path: str, content: bytes) -> tuple[str, list[tuple[str, int, bool]]]:
    """(producer, [(text, number of images, has text)]) of a PDF that lies in memory."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        pages = []
        for page in doc:
            parts = page.get_text("dict").get("blocks", [])
            has_text = any(b.get("type") == 0 and any(s["text"].strip() for line in b["lines"] for s in line["spans"]) for b in parts)
            pages.append((page.get_text("text"), len(page.get_images(full=True)), has_text))
        return (doc.metadata or {}).get("producer") or "", pages


def page_opener(engine: Callable[[], ImageOcr], load: Callable[[str], bytes]) -> Callable:
    """An opener for ``ocr.recognise``: opens a PDF once, then renders, levels and reads page after page.

    ``engine`` makes the recogniser, once a Python worker; ``load`` gives a file's content by its path.
    """
    made: list[ImageOcr] = []

    @contextmanager
    def opened(path: str) -> Iterator[Callable[[int, int], list[tuple[str, float]]]]:
        import fitz

        if not made:
            made.append(engine())
        with fitz.open(stream=io.BytesIO(load(path)), filetype="pdf") as doc:

            def page(page_idx: int, dpi: int) -> list[tuple[str, float]]:
                pix = doc[page_idx].get_pixmap(dpi=dpi, alpha=False)
                image = np.frombuffer(pix.samples, np.uint8).reshape(pix.height, pix.width, -1)[:, :, :3]
                return made[0](deskew(image))

            yield page

    return opened
