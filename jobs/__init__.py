"""Runnable jobs: ``python -m jobs.NAME --config FILE``. Each one's ``run`` takes a session and its settings."""
