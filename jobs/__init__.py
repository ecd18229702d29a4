"""Runnable jobs over the library: each is a function that takes a session, and a command line with a config file."""
