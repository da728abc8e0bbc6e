"""Column-level helpers: hashing, date parsing, name rules, value cleaning."""
