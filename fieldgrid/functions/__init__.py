"""Column builders: each takes Columns and returns a Column, so all of it stays in whole-stage codegen."""
