"""The queries of this package, and SQL for those that SQL can express."""

from .chunks import op4_chunks
from .decontaminate import OP9_SQL, op9_decontamination
from .html_text import op7_html
from .licenses import op3_licenses
from .minhash import OP6_SQL, op6_minhash
from .mixing import OP10_SQL, op10_mixing
from .quality import op2_quality
from .secret_scan import op5_secrets
from .suffixes import OP1_SQL, op1_suffixes
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_chunks": op4_chunks,
    "op5_secrets": op5_secrets,
    "op6_minhash": op6_minhash,
    "op7_html": op7_html,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
}
SQL = {"op1_suffixes": OP1_SQL, "op6_minhash": OP6_SQL, "op8_warc": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_mixing": OP10_SQL}
