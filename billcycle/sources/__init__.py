"""Reading tables and exports, writing month snapshots, constant dimensions."""
