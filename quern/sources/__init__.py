"""Where sources come from and releases go."""
