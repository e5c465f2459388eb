"""Sources of frames: tables and folders as one row per cycle."""
