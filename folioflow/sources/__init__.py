"""Documents as tables.

Files come in through Spark's own ``binaryFile`` and text readers, so any store that
Spark reads will do; a file is parsed in the task that holds it.
"""

from .office import blocks, cells, comments, geometry, links, merges, parts, relationships, slides, tables  # noqa: F401
from .plain import csv_rows, html_files, image_files, json_values, rtf_paragraphs, text_paragraphs  # noqa: F401
from .router import read  # noqa: F401
