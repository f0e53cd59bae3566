"""DataFrame operators on recordings, events, spikes and waveforms."""
