"""Runnable jobs. Each is a module with a run() that takes a session, and a command line that makes one."""
