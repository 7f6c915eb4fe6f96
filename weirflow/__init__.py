"""weirflow: a PySpark-native engine that prepares text, tables and tool output for AI systems."""

from weirflow.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
