"""The relations of the engine.  Order is data: ``file_ord`` and ``block_ord`` carry it."""

BLOCKS = (
    "file string, path string, page int, chapter string, text string, scanned boolean, "
    "render_info struct<pdf_path:string,page_idx:int,dpi:int>, ocr_error string, file_ord long, block_ord long, ocr_conf double"
)
RAW_PAGES = "path string, producer string, page_idx int, raw_text string, n_images int, has_text_block boolean, error string"
RAW_PARAGRAPHS = "path string, para_idx int, text string, style string, error string"
NO_CHAPTER = "（未识别章节）"
OCR_DPI = 300
