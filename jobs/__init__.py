"""Runnable jobs over the library's operators; each has a command line and a configuration file beside it."""
