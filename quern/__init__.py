"""quern: corpus tokenisation and token analytics as Spark plans."""

from quern.session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
