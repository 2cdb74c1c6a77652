"""Table operators over ordered sequences."""
