"""Sources: caption files, tracks, frames, checkpoints, fixtures."""
