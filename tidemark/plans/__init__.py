"""The pipeline that chains the operators, its runners and command lines."""
