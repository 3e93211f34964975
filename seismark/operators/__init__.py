"""Operators over series tables, as DataFrame compositions; grouped Arrow functions where a recursion needs them."""
