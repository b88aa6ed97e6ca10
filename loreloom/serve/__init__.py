"""Ways to ask an engine from outside: a command line and JSON over HTTP."""
