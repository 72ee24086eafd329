"""Document extraction and structure mining on Spark DataFrames."""

from paperloom.functions.keys import EXTRACT_VERSION
from paperloom.functions.markdown import section
from paperloom.operators.extract import extract
from paperloom.schemas import ExtractedDoc, ExtractedFigure, ExtractedReference, ExtractedTable

__version__ = EXTRACT_VERSION
__all__ = ["EXTRACT_VERSION", "ExtractedDoc", "ExtractedFigure", "ExtractedReference", "ExtractedTable", "__version__", "extract", "section"]
